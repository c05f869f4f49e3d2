"""Reading products, offers, texts and image folders."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import literals as L
from ..functions import text as TX

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without blanks and non-breaking spaces at their ends; of equal names the first column stays."""
    names = [c.replace(" ", " ").strip() for c in df.columns]
    marked = df.toDF(*[f"c{i}" for i in range(len(names))])
    first = [i for i, c in enumerate(names) if c not in names[:i]]
    return marked.select(*[F.col(f"c{i}").alias(names[i]) for i in first])


def to_internal(df: DataFrame, names: dict[str, str] = S.RESULT_COLUMNS) -> DataFrame:
    """External column names replaced by ours."""
    return df.withColumnsRenamed({v: k for k, v in names.items() if v in df.columns})


def require(df: DataFrame, columns: tuple[str, ...] = S.REQUIRED) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    return df


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """Rows of a workbook's first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        sheet = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{SHEET}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{SHEET}c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                at = at - 1 if letters else len(cells)
                cells += [None] * (at - len(cells))
                v, kind = c.find(f"{SHEET}v"), c.get("t")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{SHEET}t")))
                elif v is None or v.text is None:
                    cells.append(None)
                else:
                    cells.append(shared[int(v.text)] if kind == "s" else v.text)
            rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook at ``path`` as text columns, named by the first row of the first workbook, with ``ordinal``.

    Workbooks are read by Spark's binary source, so any store works; each is parsed by one task. Lock files (``~$``) are passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.xlsx").load(path)

    @F.pandas_udf("array<array<string>>")
    def parse(content: pd.Series) -> pd.Series:
        return pd.Series([sheet_rows(bytes(c)) for c in content])

    rows = files.select("path", F.posexplode(parse("content")).alias("ordinal", "cells"))
    head = rows.filter("ordinal = 0").orderBy("path").limit(1).collect()  # a workbook's header
    if not head:
        raise FileNotFoundError(f"no workbook at {path}")
    names = [c or f"column{i}" for i, c in enumerate(head[0]["cells"])]
    body = rows.filter("ordinal > 0").select((F.col("ordinal") - 1).alias("ordinal"), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))])
    return clean_names(body.toDF("ordinal", *names))


def read_products(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Products under our names with their required columns, from a workbook, CSV, JSON, ORC or Parquet."""
    if kind == "xlsx":
        df = read_xlsx(spark, path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True)
    else:
        df = spark.read.format(kind).load(path)
    return require(to_internal(clean_names(df)))


def without_bracket_names(df: DataFrame, column: str = "product_name") -> DataFrame:
    return df.withColumn(column, TX.without_brackets(F.col(column)))


def quantities_by_word(df: DataFrame, words: tuple[str, ...] = ("수량", "quantity")) -> DataFrame:
    """Distinct positive quantities, rising, of the first column whose name holds one of the words."""
    column = next((c for c in df.columns if any(w in c.lower() for w in words)), None)
    if column is None:
        return df.sparkSession.createDataFrame([], "quantity long")
    return df.select(TX.whole_quantity(F.col(f"`{column}`")).alias("quantity")).filter("quantity IS NOT NULL").distinct().orderBy("quantity")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a CSV as ``name`` with its search keywords."""
    df = spark.read.csv(path, header=True)
    return df.select(F.col(f"`{df.columns[0]}`").alias("name")).withColumn("keywords", TX.meaningful_keywords(F.col("name")))


def read_query_and_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A text file's first line as ``query`` beside each later line as ``name``, with ``ordinal``."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ordinal", "name"))
    query = lines.filter("ordinal = 0").select(F.col("name").alias("query"))
    return lines.filter("ordinal > 0 AND trim(name) <> ''").crossJoin(F.broadcast(query.limit(1))).select("query", (F.col("ordinal") - 1).alias("ordinal"), "name")


OFFER_PAGE = T.StructType([T.StructField("query", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def search_pages(pages: DataFrame, max_items: int = 80, page_size: int = 100) -> DataFrame:
    """Items of landed search result pages (``query, page, total, items``) in order, ``max_items`` for each query at most.

    Pages count up to the first that is empty or short; what lies beyond it is passed over.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("query").orderBy("page")
    n = F.coalesce(F.size("items"), F.lit(0))
    ended = F.coalesce(F.max((n < page_size).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    live = pages.withColumn("__ended", ended).filter("__ended = 0").select("query", "page", F.posexplode("items").alias("at", "item"))
    live = live.withColumn("ordinal", (F.col("page") - 1) * page_size + F.col("at"))
    return live.filter(F.col("ordinal") < max_items).select("query", "ordinal", "item")


def image_files(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """``path, length, modificationTime`` of images below a folder; their content isn't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,gif,JPG,JPEG,PNG,GIF}")
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return r.load(path).select("path", "length", "modificationTime")


def recent(df: DataFrame, after: Column | str | None = None, before: Column | str | None = None, least_bytes: int = 0, name: str | None = None) -> DataFrame:
    """``df``, read from files of any kind, with ``file, file_bytes, file_time`` of the file of each row; only files last changed at or after ``after`` and
    before ``before``, of ``least_bytes`` at least, and whose name fits the regular expression ``name``. Lock files (``~$``) are passed over.

    The conditions are on the hidden file columns, so files that fail them are left out when the scan is planned and never opened.
    """
    m = lambda c: F.col(f"_metadata.{c}")
    time = lambda t: F.lit(t).cast("timestamp") if isinstance(t, str) else t
    out = df.filter(~m("file_name").startswith("~$")).filter(m("file_size") >= least_bytes)
    if after is not None:
        out = out.filter(m("file_modification_time") >= time(after))
    if before is not None:
        out = out.filter(m("file_modification_time") < time(before))
    if name is not None:
        out = out.filter(m("file_name").rlike(name))
    return out.select("*", m("file_name").alias("file"), m("file_size").alias("file_bytes"), m("file_modification_time").alias("file_time"))


def last_days(df: DataFrame, days: int, now: str | None = None, **more) -> DataFrame:
    """:func:`recent` for the last ``days`` days before ``now``, a timestamp in text, else the present."""
    end = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return recent(df, after=end - F.make_dt_interval(F.lit(days)), **more)


def tiers_of_row(df: DataFrame, raw: str = "tiers_json", quantity: str = "k_qty", price: str = "k_price") -> DataFrame:
    """``tiers`` as a map: of a cell that holds quantities and prices as JSON or a Python literal, else of single quantity and price, else null.

    A tier's price is a number or a struct with the field ``price``.
    """
    parsed = L.literal_map(F.col(raw))
    whole = F.map_filter(parsed, lambda k, v: k.rlike("^[0-9]+$"))
    priced = F.transform_values(F.transform_keys(whole, lambda k, v: k.cast("int")), lambda k, v: F.coalesce(v.try_cast("double"), F.get_json_object(v, "$.price").try_cast("double")))
    made = F.map_filter(priced, lambda k, v: v.isNotNull())
    single = F.when(F.col(quantity).isNotNull() & F.col(price).isNotNull(), F.create_map(F.col(quantity).cast("int"), F.col(price).cast("double")))
    return df.withColumn("tiers", F.coalesce(L.let(made, lambda m: F.when(F.size(m) > 0, m)), single))
