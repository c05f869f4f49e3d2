"""Best-of-group, first-wins and ordered-distinct operators. Ties always go by an ordinal that the source carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def best(df: DataFrame, keys: list[str], score: str, ordinal: str, above: float | None = None) -> DataFrame:
    """For each key the row with the greatest score, on ties the least ordinal; only scores over ``above`` count.

    One aggregate with map-side combining: no group's rows meet in one task.
    """
    if above is not None:
        df = df.filter(F.col(score) > above)
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(ordinal))).alias("__row")
    got = df.groupBy(*keys).agg(row).select(*keys, "__row.*")
    return got.select(*df.columns)


def best_with_early_exit(df: DataFrame, keys: list[str], score: str, ordinal: str, least: float = 0.7, sure: float = 0.95) -> DataFrame:
    """As a scan in order that stops at the first score over ``sure``: that row if there is one, else the best of at least ``least``."""
    ok = df.filter(F.col(score) >= least)
    row = F.struct(*[c for c in df.columns if c not in keys])
    first = F.min_by(F.when(F.col(score) > sure, row), F.when(F.col(score) > sure, F.col(ordinal)))
    top = F.max_by(row, F.struct(F.col(score), -F.col(ordinal)))
    return ok.groupBy(*keys).agg(F.coalesce(first, top).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def first_rows(df: DataFrame, keys: list[str], ordinal: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key in order of arrival."""
    w = W.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def drop_repeats(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key; rows whose key is null throughout are one key."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("__row"))
    return got.select(*keys, "__row.*").select(*df.columns)


def concat_distinct(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames one after the other, the first row of each key kept. Each needs an ``ordinal`` column."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("__at", F.struct(F.lit(i).alias("frame"), F.col("ordinal")))
        out = f if out is None else out.unionByName(f)
    rest = [c for c in out.columns if c not in keys]
    got = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("__at")).alias("__row")).select(*keys, "__row.*")
    return got.drop("__at")


def most_results(df: DataFrame, query: str, variation: str, ordinal: str) -> DataFrame:
    """For each query the variation with the most rows; on ties the earliest."""
    counts = df.groupBy(query, variation).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy(query).agg(F.max_by(F.struct(variation, "n"), F.struct(F.col("n"), -F.col("first"))).alias("b")).select(query, "b.*")


def restore_missing(df: DataFrame, original: DataFrame, row_id: str) -> DataFrame:
    """``df`` with those rows of ``original`` whose id it lost."""
    lost = original.join(df.select(row_id), row_id, "left_anti")
    return df.unionByName(lost.select(*original.columns), allowMissingColumns=True)


def above_threshold(df: DataFrame, score: str, ordinal: str, least: float | None, keys: list[str] | None = None, first: int = 5) -> DataFrame:
    """Candidates of at least ``least`` by falling score, ties in order of arrival; without a scorer (None) the first few of each key."""
    if least is None:
        return first_rows(df, keys or [F.lit(1)], ordinal, first)
    return df.filter(F.col(score) >= least).orderBy(F.desc(score), ordinal)


def top_one(df: DataFrame, score: str, ordinal: str, least: float) -> DataFrame:
    """The best candidate, or no row if none reaches ``least``."""
    return df.filter(F.col(score) >= least).orderBy(F.desc(score), ordinal).limit(1)


def natural_order(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(T.natural_key(F.col(name)), name)


def batches(ordinal: Column, size: int = 100) -> Column:
    """The number of the batch that a row belongs to."""
    return F.floor(ordinal / size).cast("long")


def keep_first_columns(names: list[str]) -> list[int]:
    """Places of the columns to keep where names repeat: the first of each."""
    return [i for i, c in enumerate(names) if c not in names[:i]]
