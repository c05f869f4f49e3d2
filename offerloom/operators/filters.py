"""Row filters, and clears that keep a row but empty a group of its columns.

Values stay typed: an emptied cell is null, and only the sinks write a placeholder for it. A column that a frame doesn't have counts as missing
where the rule says so, and is otherwise passed over; that is settled when the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import schema as S
from ..functions import nulls as N
from ..functions import text as T

K_GROUP = ("k_qty", "k_price", "k_unit_price", "k_diff", "k_diff_pct", "k_link", "k_image")
N_GROUP = ("n_qty", "n_price", "n_diff", "n_diff_pct", "n_diff_ratio", "n_supplier", "n_supplier_link", "n_link", "n_image")
N_DATA = ("n_qty", "n_price", "n_diff", "n_diff_pct", "n_supplier", "n_link")
K_DATA = ("k_qty", "k_price", "k_diff", "k_diff_pct", "k_link")


def have(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


def number(df: DataFrame, name: str) -> Column:
    """A column as a number; one that has a numeric type isn't parsed from text again, which keeps the generated code small."""
    return F.col(name).cast("double") if isinstance(df.schema[name].dataType, NumericType) else N.to_number(F.col(name))


def clear(df: DataFrame, when: Column, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns ``names`` null in the rows where ``when`` is true."""
    when = N.true(when)
    return df.withColumns({c: F.when(when, F.lit(None)).otherwise(F.col(c)) for c in have(df, names)})


def clear_unfavourable(df: DataFrame) -> DataFrame:
    """Differences become numbers; a competitor's group is cleared if its difference is 0 or more, or its percentage above -1."""
    df = df.withColumns({c: number(df, c) for c in have(df, ("k_diff", "n_diff", "k_diff_pct", "n_diff_pct", "n_diff_ratio"))})
    for diff, pcts, group in (("k_diff", ("k_diff_pct",), K_GROUP), ("n_diff", ("n_diff_ratio", "n_diff_pct"), N_GROUP)):
        tests = [F.col(diff) >= 0] if diff in df.columns else []
        tests += [F.col(c) > -1 for c in have(df, pcts)[:1]]
        if tests:
            df = clear(df, reduce(lambda a, b: N.true(a) | N.true(b), tests), group)
    return df


def rendered_differences(df: DataFrame) -> DataFrame:
    """Differences as text: percentages cut to whole numbers with a sign, amounts with thousands separated."""
    pct = {c: F.when(F.col(c).isNotNull(), F.concat(F.col(c).cast("int").cast("string"), F.lit(" %"))) for c in have(df, ("k_diff_pct", "n_diff_pct", "n_diff_ratio"))}
    return df.withColumns(pct | {c: F.format_number(F.col(c).cast("double"), 0) for c in have(df, ("k_diff", "n_diff"))})


def filter_results(df: DataFrame, most: float = 0.1, grades: tuple[str, ...] = ("high", "medium", "low")) -> DataFrame:
    """Rows whose difference ratios are at most ``most`` either way and whose quality is among ``grades``; null fails, absent columns don't count."""
    for c in have(df, ("k_diff_ratio", "n_diff_ratio")):
        df = df.filter(F.abs(F.col(c)) <= most)
    return df.filter(F.col("quality").isin(*grades)) if "quality" in df.columns else df


def upload_condition(df: DataFrame, threshold: float = -1.0) -> Column:
    """Whether a competitor with a link is cheaper by more than ``-threshold``."""
    found = [~N.missing_upload(F.col(f"{s}_link")) & (number(df, f"{s}_diff") < threshold) for s in "kn" if f"{s}_link" in df.columns and f"{s}_diff" in df.columns]
    return reduce(lambda a, b: a | b, (N.true(x) for x in found), F.lit(False))


def filter_upload(df: DataFrame, threshold: float = -1.0) -> DataFrame:
    return df.filter(upload_condition(df, threshold))


def replace_front_urls(df: DataFrame, marker: str = "front/", placeholder: str = "") -> DataFrame:
    """Unreliable image addresses of the shopping search become ``placeholder``; the address moves to ``original_url``."""
    url = F.col("n_image.url")
    return df.withColumn("n_image", F.when(F.lower(url).contains(marker), F.col("n_image").withField("original_url", url).withField("url", F.lit(placeholder))).otherwise(F.col("n_image")))


def upload_rows(df: DataFrame, row_id: str, strict: bool = True, threshold: float = -1.0, least_share: float = 0.1, small: int = 5, add_back: int = 5) -> DataFrame:
    """The rows to upload. If fewer than ``least_share`` of more than ``small`` rows would stay, the first ``add_back`` of the others, by ``row_id``, stay too."""
    if not strict:
        return df
    marked = df.withColumn("__keep", upload_condition(df, threshold))
    sums = marked.agg(F.count("*").alias("__n"), F.count_if("__keep").alias("__kept"))  # one row
    few = (F.col("__n") > small) & (F.col("__kept") < F.col("__n") * least_share)
    back = marked.filter(~F.col("__keep")).orderBy(row_id).limit(add_back).crossJoin(F.broadcast(sums)).filter(few).select(*df.columns)
    return marked.filter("__keep").select(*df.columns).unionByName(back)


def clean_market_data(df: DataFrame) -> DataFrame:
    """Without an image the shopping search's columns go; with an image but none of its data the image goes.

    A quantity, price or difference is data if it is a number other than zero, another column if it isn't a placeholder.
    """
    if isinstance(df.schema["n_image"].dataType.typeName(), str) and df.schema["n_image"].dataType.typeName() == "struct":
        missing = N.missing_market_image(F.col("n_image.url"), F.col("n_image.local_path"), F.col("n_image.source"), "naver")
    else:
        missing = F.col("n_image").isNull() | F.trim("n_image").isin("", "-")
    missing = N.true(missing)
    data = [N.true(number(df, c) != 0) if c in ("n_qty", "n_price", "n_diff") else ~N.missing_upload(F.col(c)) for c in have(df, N_DATA)]
    some = reduce(lambda a, b: a | b, data, F.lit(False))
    out = {c: F.when(~missing, F.col(c)) for c in have(df, N_DATA)}
    return df.withColumns(out | {"n_image": F.when(missing | some, F.col("n_image"))})


def invalid_market_rows(df: DataFrame) -> DataFrame:
    """Rows of the shopping search to drop as a whole: by rule there are none."""
    return df.limit(0)


def clear_without_k_image(df: DataFrame) -> DataFrame:
    """The promotional competitor's data go where its image is missing."""
    image = F.col("k_image.url") if df.schema["k_image"].dataType.typeName() == "struct" else F.col("k_image")
    return clear(df, N.missing_image(image), K_DATA)


def filter_by_difference(df: DataFrame, columns: tuple[str, ...] = ("k_diff", "n_diff"), threshold: float = -1.0) -> DataFrame:
    """Rows of which every difference is below the threshold or no number."""
    for c in have(df, columns):
        x = number(df, c)
        df = df.filter(x.isNull() | (x < threshold))
    return df


def image_similarity(image: str, df: DataFrame) -> Column:
    """An image's similarity, else its score, else 0; text that is no number counts as 0."""
    fields = df.schema[image].dataType.fieldNames()
    got = [F.col(f"{image}.{f}").cast("string").try_cast("double") for f in ("similarity", "score") if f in fields]
    return F.coalesce(*got, F.lit(0.0))


def filter_images(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Competitor images less similar than their threshold go, with the group of columns they stand for."""
    groups = {"n_image": ("n_price", "n_diff", "n_diff_pct", "n_qty", "n_link", "n_supplier_link", "n_supplier"), "k_image": ("k_price", "k_diff", "k_diff_pct", "k_qty", "k_link")}
    for image, least in (thresholds or S.Thresholds().image_filter).items():
        if image in df.columns:
            low = F.col(image).isNull() | (image_similarity(image, df) < least)
            df = df.withColumn("__low", low)
            df = clear(df, F.col("__low"), (*groups[image], image)).drop("__low")
    return df


def complete_market_image(df: DataFrame, template: str = "", clear_empty: bool = True) -> DataFrame:
    """Images of the shopping search get an address: their own, the original's, or one made of the product id; without any and without a file they go."""
    i = lambda f: F.nullif(F.col(f"n_image.{f}"), F.lit(""))
    made = F.when(i("product_id").isNotNull() & F.lit(bool(template)), F.replace(F.lit(template), F.lit("{id}"), i("product_id")))
    url = F.coalesce(i("url"), i("original_url"), F.when(T.is_http(i("original_path")), i("original_path")), made)
    gone = F.lit(clear_empty) & url.isNull() & i("local_path").isNull()
    return df.withColumn("n_image", F.when(F.col("n_image").isNotNull() & ~gone, F.col("n_image").withField("url", url)))


def clear_market_without_image(df: DataFrame, strict: bool = False) -> DataFrame:
    """Strict: without address and file the whole group goes; else nothing changes."""
    if not strict:
        return df
    gone = N.missing_link(F.col("n_image.url")) & N.missing_link(F.col("n_image.local_path"))
    return clear(df, gone, N_GROUP)


def clear_market_without_link(df: DataFrame, strict: bool = False) -> DataFrame:
    return clear(df, N.missing_link(F.col("n_link")), N_GROUP) if strict else df


def admit_offers(offers: DataFrame, query: str = "query", title: str = "title", seller: str = "seller", price: str = "price", promo: tuple[str, ...] = S.PROMO_SITE) -> DataFrame:
    """Search results with a price, a word in common with the query, and no sign of a promotional seller."""
    shared = F.size(F.array_intersect(T.token_set(F.col(query)), T.token_set(F.col(title)))) > 0
    p = F.col(price).cast("string")
    sound = F.when(p.rlike("^[0-9]+$"), p.try_cast("long")).otherwise(0) > 0
    return offers.filter(sound & shared & ~T.contains_any(F.col(title), promo) & ~T.contains_any(F.col(seller), promo))


def promotional(name: Column, seller: Column, link: Column, promo: tuple[str, ...] = S.PROMO_SITE) -> Column:
    """``struct(flag, words)``: the promotional words found in name, seller and link."""
    words = F.array(*[F.lit(w) for w in promo])
    where = F.lower(F.concat_ws("\n", name, seller, link))
    found = F.filter(words, lambda w: where.contains(F.lower(w)))
    return F.struct((F.size(found) > 0).alias("flag"), found.alias("words"))


def promotional_supplier(name: Column) -> Column:
    return T.contains_any(name, S.PROMO_SUPPLIER, fold=False)


def in_stock(df: DataFrame, text: str, marks: tuple[str, ...] = S.SOLD_OUT) -> DataFrame:
    return df.filter(~T.contains_any(F.col(text), marks, fold=False))


def highlight(df: DataFrame, columns: tuple[str, ...] = ("k_diff", "n_diff", "k_diff_pct", "n_diff_pct"), threshold: float = -1.0) -> DataFrame:
    """``highlight``: whether any difference column is below the threshold; ``(100)`` reads as -100."""
    tests = [N.true(N.accounting_number(F.col(c)) < threshold) for c in have(df, columns)]
    return df.withColumn("highlight", reduce(lambda a, b: a | b, tests, F.lit(False)))


def legacy_upload(df: DataFrame) -> DataFrame:
    """The older upload rules: a negative difference, then links without scheme and groups of no use cleared, then rows left blank dropped."""
    df = df.filter(N.true(number(df, "k_diff") < 0) | N.true(number(df, "n_diff") < 0))
    dash = have(df, ("k_qty", "k_price", "k_diff", "k_diff_pct", "k_link", "n_qty", "n_price", "n_diff", "n_diff_pct", "n_supplier", "n_link"))
    df = df.withColumns({c: F.when(F.col(c).cast("string") != "-", F.col(c)) for c in dash})
    df = df.withColumns({c: F.when(F.col(c).rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col(c)) for c in have(df, ("k_link", "n_link"))})
    blank = F.coalesce(F.trim(F.col("n_qty").cast("string")) == "", F.lit(True)) | N.true(number(df, "n_qty") == 0)
    promo = T.contains_any(F.col("n_supplier"), S.PROMO_UPLOAD, fold=False)
    gone = {s: N.true(number(df, f"{s}_diff") >= 0) | N.true(number(df, f"{s}_diff_pct") > -1) for s in "kn"}
    gone["n"] = gone["n"] | (blank & N.true(number(df, "n_diff_pct") > -10) & ~promo)
    # judged on the cells as they came, then cleared once: conditions on cleared cells would nest
    df = df.withColumns({"__k": gone["k"], "__n": gone["n"]})
    df = clear(clear(df, F.col("__k"), (*K_DATA, "k_image")), F.col("__n"), (*N_DATA, "n_image")).drop("__k", "__n")
    df = df.withColumn("k_qty", F.when(number(df, "k_qty").isNotNull(), F.col("k_qty")))
    some = [F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in dash]
    return df.filter(reduce(lambda a, b: a | b, some))


def business_rules(df: DataFrame) -> DataFrame:
    """The written rules: a negative difference only; shopping offers without quantity within 10 % go; rises go; rows without an offer are dropped."""
    df = clear(df, number(df, "k_diff") >= 0, K_GROUP)
    df = clear(df, number(df, "n_diff") >= 0, N_GROUP)
    df = clear(df, N.missing_upload(F.col("n_qty")) & (F.abs(number(df, "n_diff_pct")) <= 10), N_GROUP)
    return df.filter(N.true(number(df, "k_diff") < 0) | N.true(number(df, "n_diff") < 0))


def checked_images(df: DataFrame, column: str, base: str, hosts: tuple[str, ...] = ()) -> DataFrame:
    """Candidate image addresses made absolute; invalid ones become null."""
    got = T.normalise_image_url(F.col(column), base, hosts)
    return df.withColumn("__image", got).withColumn(column, F.when(F.col("__image.valid"), F.col("__image.url"))).drop("__image")


def lookable(df: DataFrame) -> DataFrame:
    """Products that an image can be looked up for: with a name or a code."""
    return df.filter((F.col("product_name").isNotNull() & (F.col("product_name") != "")) | F.col("code").isNotNull())


def sample_share(df: DataFrame, key: str, percent: float) -> DataFrame:
    """About ``percent`` of the rows, the same ones in every run and on every cluster: those whose key's hash falls below the share. Null keys stay out."""
    digits = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.filter(digits < F.lit(int(percent / 100 * 2**32)))
