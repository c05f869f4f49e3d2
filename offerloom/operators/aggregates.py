"""Groupings, counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as N


def nested_offers(offers: DataFrame, key: str = "product_name", ordinal: str = "ordinal") -> DataFrame:
    """One row per product with the array of its offers in order: for the edge, where a nested record is asked for."""
    rest = [ordinal, *[c for c in offers.columns if c not in (key, ordinal)]]
    return offers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("offers"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def valid_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many cells of each column are no placeholder."""
    return df.agg(*[F.count_if(~N.missing_upload(F.col(c))).alias(c) for c in columns])


def image_summary(df: DataFrame, columns: tuple[str, ...] = ("base_image", "k_image", "n_image")) -> DataFrame:
    """One row: rows, and for each image column how many have one and what percentage that is."""
    out = [F.count("*").alias("n_rows")]
    for c in columns:
        out += [F.count(c).alias(f"{c}_n"), F.when(F.count("*") > 0, F.count(c) * 100.0 / F.count("*")).otherwise(0.0).alias(f"{c}_pct")]
    return df.agg(*out)


def tier_bounds(tiers: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    return tiers.groupBy(*keys).agg(F.min(quantity).alias("min_qty"), F.max(quantity).alias("max_qty"), F.count_distinct(quantity).alias("n_tiers"))


def distinct_quantities(df: DataFrame, column: str) -> DataFrame:
    """Distinct quantities that are pure digits, rising."""
    q = F.col(column).cast("string")
    return df.filter(q.rlike("^[0-9]+$")).select(q.cast("long").alias("quantity")).distinct().orderBy("quantity")


def consensus(scores: Column, least: float = 0.01) -> Column:
    """One minus the population deviation of the scores above ``least``; null if there are fewer than two."""
    some = F.filter(scores, lambda x: x > least)
    n = F.size(some)
    mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n >= 2, 1 - F.sqrt(F.aggregate(some, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))


def hash_statistics(df: DataFrame, hit: str = "hit", tried: str = "product_name") -> DataFrame:
    """One row: products, hits, their share, and how it is called."""
    share = F.try_divide(F.count_if(F.col(hit)).cast("double"), F.count(tried))
    return df.agg(F.count(tried).alias("n"), F.count_if(F.col(hit)).alias("hits"), F.coalesce(share, F.lit(0.0)).alias("share")).withColumn("efficiency", F.when(F.col("share") >= 0.8, "high").when(F.col("share") >= 0.6, "medium").otherwise("low"))


def joined_set(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """For each key the distinct values, sorted and joined by commas."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",").alias("joined"))


def host_counts(df: DataFrame, column: str, hosts: dict[str, str]) -> DataFrame:
    """One row: how many cells are addresses that hold each host's name."""
    http = F.col(column).startswith("http")
    return df.agg(*[F.count_if(http & F.lower(column).contains(h)).alias(name) for name, h in hosts.items()])


def check_input(df: DataFrame, required: tuple[str, ...], numeric: tuple[str, ...] = ("base_qty", "base_price")) -> DataFrame:
    """``column, n_blank, n_not_numeric`` for each required column; an absent one has null counts. One pass over the rows."""
    there = [c for c in required if c in df.columns]
    sums = df.agg(*[F.count_if(N.missing_input(F.col(c))).alias(f"{c}__b") for c in there], *[F.count_if(~N.missing_input(F.col(c)) & N.to_number(F.col(c)).isNull()).alias(f"{c}__n") for c in there if c in numeric])
    rows = [F.struct(F.lit(c).alias("column"), (F.col(f"{c}__b") if c in there else F.lit(None).cast("long")).alias("n_blank"), (F.col(f"{c}__n") if c in there and c in numeric else F.lit(None).cast("long")).alias("n_not_numeric")) for c in required]
    return sums.select(F.inline(F.array(*rows)))


def upper_median(values: Column) -> Column:
    """The middle value, of two the upper."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))
