"""Quantity and price tables of product pages.

Pages are parsed with the standard library in Arrow UDFs, one pass a page. A detector looks at one table at a time and gives ``{quantity: price}``;
the first that finds at least one tier wins, in the order of ``DETECTORS``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import COMMON_QUANTITIES

# Words of table heads, and of notes on tax.
QUANTITY_WORDS = ("수량", "주문수량", "quantity", "qty", "개수")
PRICE_WORDS = ("단가", "가격", "판매가", "price", "금액")
GENERAL_WORDS = ("주문", "구매", "할인")
TAX_EXCLUDED = ("부가세별도", "부가세 별도", "vat별도", "vat 별도", "부가세미포함", "vat excluded")
TIERS = "array<struct<quantity:bigint,price:bigint>>"


class _Tables(HTMLParser):
    """Cells of every table as text; input fields contribute their value and class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.inputs, self.skip = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append("")
        elif tag == "input":
            a = dict(attrs)
            self.inputs.append((a.get("class") or "", a.get("value") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if not self.skip and self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1] += data


def parse(html: str | None) -> tuple[list[list[list[str]]], list[tuple[str, str]]]:
    """Tables, inner ones before outer, as rows of trimmed cells; and input fields as (class, value)."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    tables = p.tables + p.open[::-1]
    return [[[" ".join(c.split()) for c in row] for row in t if row] for t in tables], p.inputs


def number(text: str) -> int | None:
    """A cell's number: what stands before ``~`` or ``-``, digits only; ``미만`` (below) is no number."""
    if "미만" in text:
        return None
    digits = re.sub(r"\D", "", text.split("~")[0].split("-")[0])
    return int(digits) if digits and len(digits) < 16 else None


def _has(cell: str, words: tuple[str, ...]) -> bool:
    return any(w in cell.lower() for w in words)


def _pairs(found) -> dict[int, int]:
    out: dict[int, int] = {}
    for q, p in found:
        if q and p and q > 0 and p > 0:
            out.setdefault(q, p)
    return dict(sorted(out.items()))


def by_head(table: list[list[str]]) -> dict[int, int]:
    """Columns named by words for quantity and price, in the first row or the second."""
    for i, row in enumerate(table[:2]):
        q = next((k for k, c in enumerate(row) if _has(c, QUANTITY_WORDS)), None)
        p = next((k for k, c in enumerate(row) if _has(c, PRICE_WORDS) and k != q), None)
        if q is not None and p is not None:
            return _pairs((number(r[q]), number(r[p])) for r in table[i + 1 :] if len(r) > max(q, p))
    return {}


def by_quantity_columns(table: list[list[str]]) -> dict[int, int]:
    """Quantities as column heads, prices of at most eight digits and below ten million in one of the next three rows."""
    if not table:
        return {}
    heads = [(k, int(re.sub(r"\D", "", c))) for k, c in enumerate(table[0]) if re.fullmatch(r"[\d,]+\s*(개|EA|ea|pcs)?", c) and re.sub(r"\D", "", c)]
    if len(heads) < 2:
        return {}
    out: dict[int, int] = {}
    for row in table[1:4]:
        for k, q in heads:
            digits = re.sub(r"\D", "", row[k]) if k < len(row) else ""
            if digits and len(digits) <= 8 and 0 < int(digits) < 10_000_000:
                out.setdefault(q, int(digits))
    return _pairs(out.items())


def by_quantity_row(table: list[list[str]]) -> dict[int, int]:
    """A row that begins with a word for quantity and one that begins with a word for price."""
    q = next((r for r in table if r and _has(r[0], QUANTITY_WORDS)), None)
    p = next((r for r in table if r and r is not q and _has(r[0], PRICE_WORDS)), None)
    return _pairs((number(a), number(b)) for a, b in zip(q[1:], p[1:])) if q and p else {}


def by_common_quantities(table: list[list[str]]) -> dict[int, int]:
    """Rows of which one cell is a usual quantity and another a number of 10 or more."""
    out = []
    for row in table:
        n = [number(c) for c in row]
        q = next((k for k, x in enumerate(n) if x in COMMON_QUANTITIES), None)
        p = next((x for k, x in enumerate(n) if x and x >= 10 and k != q), None)
        if q is not None and p:
            out.append((n[q], p))
    return _pairs(out) if len(out) >= 2 else {}


def by_first_columns(table: list[list[str]]) -> dict[int, int]:
    """The first two columns, where every row below the head has numbers in both."""
    rows = [(number(r[0]), number(r[1])) for r in table[1:] if len(r) >= 2]
    return _pairs(rows) if rows and all(q and p for q, p in rows) else {}


DETECTORS = (by_head, by_quantity_columns, by_quantity_row, by_common_quantities, by_first_columns)


def table_score(table: list[list[str]]) -> int:
    """How much a table looks like a price table: 5 for each kind of head word, 3 for a general one with prices, 2 for each usual quantity and for each head of digits from three on."""
    text = " ".join(c for r in table for c in r).lower()
    price = _has(text, PRICE_WORDS)
    score = 5 * _has(text, QUANTITY_WORDS) + 5 * price + 3 * (price and _has(text, GENERAL_WORDS))
    cells = {re.sub(r"\D", "", c) for r in table for c in r}
    score += 2 * sum(str(q) in cells for q in COMMON_QUANTITIES)
    heads = sum(bool(re.fullmatch(r"[\d,]+", c)) for c in (table[0] if table else []))
    return score + 2 * heads * (heads >= 3)


def by_inputs(inputs: list[tuple[str, str]]) -> dict[int, int]:
    """Input fields of the classes ``qu`` and ``pr`` in pairs."""
    q = [number(v) for c, v in inputs if "qu" in c.split()]
    p = [number(v) for c, v in inputs if "pr" in c.split()]
    return _pairs(zip(q, p))


def from_numbers(numbers: list[int]) -> dict[int, int]:
    """Of a page's numbers in order: each usual quantity with the next number from 100 to below 100,000; six numbers and three quantities are needed."""
    if len(numbers) < 6 or sum(n in COMMON_QUANTITIES for n in numbers) < 3:
        return {}
    out = []
    for i, n in enumerate(numbers):
        if n in COMMON_QUANTITIES:
            p = next((x for x in numbers[i + 1 : i + 4] if 100 <= x < 100_000 and x not in COMMON_QUANTITIES), None)
            out.append((n, p))
    return _pairs(out)


def tiers_of(html: str | None) -> tuple[dict[int, int], bool, str | None]:
    """Tiers, whether tax is excluded, and which detector found them."""
    tables, inputs = parse(html)
    excluded = any(w in (html or "").lower() for w in TAX_EXCLUDED)
    ranked = sorted(tables, key=lambda t: -table_score(t))
    for detect in DETECTORS:
        for t in ranked:
            if found := detect(t):
                return found, excluded, detect.__name__
    if found := by_inputs(inputs):
        return found, excluded, "by_inputs"
    if found := from_numbers([n for t in tables for r in t for c in r if (n := number(c))]):
        return found, excluded, "from_numbers"
    return {}, excluded, None


def all_detectors(html: str | None) -> list[tuple[str, dict[int, int]]]:
    """Each detector that finds tiers, in order of priority, with those of the best table for it."""
    tables, inputs = parse(html)
    ranked = sorted(tables, key=lambda t: -table_score(t))
    out = [(detect.__name__, next((found for t in ranked if (found := detect(t))), {})) for detect in DETECTORS]
    out += [("by_inputs", by_inputs(inputs)), ("from_numbers", from_numbers([n for t in tables for r in t for c in r if (n := number(c))]))]
    return [(name, found) for name, found in out if found]


def price_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``tiers`` (rising quantity), ``tax_excluded`` and ``detector``. A page without a table has no tiers."""

    @F.pandas_udf(f"tiers {TIERS}, tax_excluded boolean, detector string")
    def detect(texts: pd.Series) -> pd.DataFrame:
        got = [tiers_of(t) for t in texts]
        return pd.DataFrame({"tiers": [[{"quantity": q, "price": p} for q, p in g[0].items()] for g in got], "tax_excluded": [g[1] for g in got], "detector": [g[2] for g in got]})

    return pages.withColumn("__t", detect(html)).select(*pages.columns, "__t.*")


def tier_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row for each tier: key, quantity, price and price with tax (added where the page excludes it)."""
    rows = price_tables(pages, html).select(key, "tax_excluded", F.inline("tiers"))
    return rows.withColumn("price_with_tax", F.when(F.col("tax_excluded"), F.rint(F.col("price") * 1.1)).otherwise(F.col("price")).cast("long"))


def transposed(df: DataFrame, keys: list[str], quantities: list[str]) -> DataFrame:
    """A table with a column for each quantity as rows of quantity and price: an unpivot."""
    return df.unpivot(keys, quantities, "quantity", "price").withColumn("quantity", F.regexp_replace("quantity", r"\D", "").try_cast("long")).filter("price IS NOT NULL")


def numbered_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tiers of columns named ``qty_N`` and ``price_N``."""
    n = [c[4:] for c in df.columns if re.fullmatch(r"qty_\d+", c) and f"price_{c[4:]}" in df.columns]
    listed = F.array(*[F.struct(F.col(f"qty_{i}").cast("long").alias("quantity"), F.col(f"price_{i}").cast("double").alias("price")) for i in n])
    return df.select(*keys, F.inline(F.filter(listed, lambda x: x["quantity"].isNotNull() & x["price"].isNotNull())))
