"""Projections to the external layouts, and writers. Only here do empty cells turn into placeholders."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import nulls as N
from ..functions import text as T

# Further columns that may hold a price, in the order they are tried.
ALTERNATES = {"k_price": ("판매단가2(VAT포함)", "판매단가(V포함)(2)", "고려가격", "고려기프트판매가"), "n_price": ("판매단가3 (VAT포함)", "판매단가(V포함)(3)", "네이버가격", "네이버판매가")}


def fill_from_alternates(df: DataFrame, alternates: dict[str, tuple[str, ...]] = ALTERNATES) -> DataFrame:
    """Each price column gives way as a whole to the alternate with the most valid cells, if those are more than its own; earlier ones win ties.

    One pass counts all columns; one row of counts reaches the driver.
    """
    there = {c: [a for a in alts if a in df.columns and a != c] for c, alts in alternates.items() if c in df.columns}
    wanted = sorted({x for c, alts in there.items() for x in (c, *alts)})
    if not any(there.values()):
        return df
    counts = df.agg(*[F.count_if(~N.missing_upload(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
    n = {c: counts[i] for i, c in enumerate(wanted)}
    for c, alts in there.items():
        top = max(alts, key=lambda a: n[a], default=c)
        if alts and n[top] > n[c]:
            df = df.withColumn(c, N.to_number(F.col(f"`{top}`")))
    return df


def result_frame(df: DataFrame) -> DataFrame:
    """The full result under our names: all columns in order, absent ones null, numbers typed where any cell is a number."""
    df = fill_from_alternates(df)
    texts = [c for c in S.NUMERIC if c in df.columns and df.schema[c].dataType.typeName() == "string"]
    if texts:
        any_number = df.agg(*[F.count(N.to_number(F.col(c))).alias(c) for c in texts]).first()
        df = df.withColumns({c: N.to_number(F.col(c)) for c in texts if any_number[c]})
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in S.RESULT_COLUMNS])


def plain(c: Column) -> Column:
    """A cell as text: whole numbers without decimals."""
    return F.when(c.cast("double") == F.floor(c.cast("double")), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def placeholder(df: DataFrame, mark: str = "-") -> DataFrame:
    """Null and empty cells outside the image columns as ``mark``; everything as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in S.IMAGES or f.name in [S.RESULT_COLUMNS[i] for i in S.IMAGES]:
            out.append(c)
            continue
        text = plain(c) if f.dataType.typeName() in ("double", "float") else c.cast("string")
        out.append(F.when(text.isNull() | (text == ""), mark).otherwise(text).alias(f.name))
    return df.select(*out)


def image_urls(df: DataFrame) -> DataFrame:
    """Image structs as their http address, or empty."""
    for c in S.IMAGES:
        if c in df.columns and df.schema[c].dataType.typeName() == "struct":
            df = df.withColumn(c, F.when(T.is_http(F.col(c)["url"]), F.col(c)["url"]).otherwise(""))
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names[c]) for c in names])


def result_table(df: DataFrame) -> DataFrame:
    """The result under its external names, placeholders in place."""
    return renamed(placeholder(image_urls(result_frame(df))), S.RESULT_COLUMNS)


def upload_table(df: DataFrame) -> DataFrame:
    """The reduced layout for the upload; empty cells are empty text and numbers lose their commas."""
    frame = image_urls(result_frame(df))
    cells = [F.coalesce(plain(N.to_number(F.col(c))) if c in S.NUMERIC else F.col(c).cast("string"), F.lit("")).alias(c) for c in S.UPLOAD_COLUMNS]
    return renamed(frame.select(*cells), S.UPLOAD_COLUMNS)


def output_name(stem: str, kind: str, at: datetime, extension: str = "") -> str:
    """``<stem without -YYYYMMDD>_<kind>_<time>``."""
    import re

    return f"{re.sub(r'-[0-9]{8}$', '', stem)}_{kind}_{at:%Y%m%d_%H%M%S}{extension}"


def write_split(df: DataFrame, folder: str, stem: str, at: datetime, kind: str = "parquet") -> tuple[str, str]:
    """Writes result and upload below ``folder`` and returns both paths. The frame is planned once for each."""
    paths = tuple(f"{folder}/{output_name(stem, k, at)}" for k in ("result", "upload"))
    for path, table in zip(paths, (result_table(df), upload_table(df))):
        w = table.write.mode("overwrite")
        w.option("header", "true").csv(path) if kind == "csv" else w.format(kind).save(path)
    return paths


def counted_write(df: DataFrame, write: Callable[[DataFrame], None], counts: dict[str, Column]) -> dict[str, int]:
    """Runs ``write`` on ``df`` and returns how many rows it had and for how many each condition held, counted in the same pass as they are written."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(condition).alias(name) for name, condition in counts.items()]))
    return {name: seen.get[name] for name in ("rows", *counts)}


def both_tables(df: DataFrame, upload: Column | None = None) -> DataFrame:
    """Rows of the result and of the upload in one frame, from one pass over ``df``.

    ``table`` names the layout, ``r0, r1, ...`` are the result's columns and ``u0, u1, ...`` the upload's, null in rows of the other. Only rows that
    ``upload``, a condition on our names, holds for have an upload row.
    """
    frame = image_urls(result_frame(df))
    marked = frame.withColumn("__in", F.lit(True) if upload is None else F.coalesce(upload, F.lit(False)))
    cells = placeholder(frame).columns
    text = {f.name: plain(F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string") for f in frame.schema.fields}
    result = {c: text[c] if c in S.IMAGES else F.when(text[c].isNull() | (text[c] == ""), "-").otherwise(text[c]) for c in cells}
    reduced = {c: F.coalesce(plain(N.to_number(F.col(c))) if c in S.NUMERIC else F.col(c).cast("string"), F.lit("")) for c in S.UPLOAD_COLUMNS}
    tables = marked.withColumn("table", F.explode(F.when(F.col("__in"), F.array(F.lit("result"), F.lit("upload"))).otherwise(F.array(F.lit("result")))))
    own = lambda cells, table, letter: [F.when(F.col("table") == table, c).alias(f"{letter}{i}") for i, c in enumerate(cells.values())]
    return tables.select("table", *own(result, "result", "r"), *own(reduced, "upload", "u"))


def write_pair(df: DataFrame, folder: str, stem: str, at: datetime, upload: Column | None = None) -> str:
    """Writes result and upload in one job and returns where. Its manifest, ``<path>.manifest.json``, is put in place last, by a rename.

    The manifest holds the layouts and the rows of each table, counted as they were written. A run that fails leaves no manifest, and :func:`read_pair` reads nothing without one.
    """
    path = f"{folder}/{output_name(stem, 'pair', at)}"
    counts = counted_write(both_tables(df, upload), lambda t: t.write.partitionBy("table").parquet(path), {t: F.col("table") == t for t in ("result", "upload")})
    manifest = {"rows": {t: counts[t] for t in ("result", "upload")}, "result": list(S.RESULT_COLUMNS.values()), "upload": list(S.UPLOAD_COLUMNS.values())}
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    made, final = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in (".manifest.tmp", ".manifest.json"))
    store = final.getFileSystem(conf)
    out = store.create(made, True)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
    out.close()
    if not store.rename(made, final):
        raise FileExistsError(f"{path}.manifest.json")
    return path


def read_pair(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``result`` or ``upload`` of a finished :func:`write_pair`, under its external names."""
    told = spark.read.text(f"{path}.manifest.json", wholetext=True).first()
    names = json.loads(told[0])[table]
    return spark.read.parquet(path).filter(F.col("table") == table).select(*[F.col(f"{table[0]}{i}").alias(n) for i, n in enumerate(names)])


def write_csv(df: DataFrame, path: str) -> None:
    """Plain CSV with a header; arrays and maps as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("header", "true").csv(path)
