"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Every source gets its share of the total by weight. Sources whose share exceeds ``max_epochs`` times their size are clamped
there and what they can't take is shared among the others by weight, again until no source is above its clamp. Then each
document is taken as often as whole repetitions fit into its source's rate, and the rest of the target is filled by documents in
an order drawn from a seed; the one that the target's end falls into is repeated in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources(source, ...)`` with ``weight``: the weights in turn over the sources by code point, null last.

    The numbering needs no single task: the names are dealt out by ranges, and each range adds what the ranges before it hold.
    """
    spark = sources.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = durable(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = durable(dealt.groupBy("part").count(), "counts")
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = before.select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("skipped"))
    number = F.col("skipped") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (number % len(weights)).cast("int") + 1)
    return dealt.join(before, "part").withColumn("weight", weight).drop("part", "skipped")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``.

    The targets add up to ``share`` times all sizes, or to all clamps if those are less. Each round sums what is clamped on the
    executors and brings three sums to the driver; it ends when a round clamps nothing new. A source without words gets 0.
    """
    base = durable(sources.withColumn("cap", F.col("source_size") * float(max_epochs)), "sources")
    total = float(share) * (base.agg(F.sum("source_size")).first()[0] or 0)
    level: float | None = None  # what a unit of weight gets
    clamped = -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("cap")
        n, taken, weight = base.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (total - taken) / weight
    unit = F.lit(level if level is not None else 0.0)
    fits = F.lit(False) if not weight else F.col("weight") * unit < F.col("cap")
    return base.withColumn("target", F.when(fits, F.col("weight") * unit).otherwise(F.col("cap"))).drop("cap")


def draw(doc_id: Column, seed: int) -> Column:
    """The place of a document in its source's drawn order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken`` and the columns in ``keep``.

    ``size`` counts the words of the text (null: 0); ``taken`` is the words the mix takes of it, repeats counted, and
    ``taken / size`` its repetitions. The words taken of a source add up to its target, rounded down to whole words. The order of
    the fractional repetitions depends on ``seed`` and ``doc_id`` alone, ties (equal ids) broken by size, then by text. A null source is
    a source of its own, after all others. An empty table gives none.

    A source's order is found in two steps, so that no task sees a whole source: sums by the first digits of the draw,
    then exact sums within one such bucket.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", *[c for c in keep], F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("__tie"), draw(F.col("doc_id"), seed).alias("__draw"))
    rows = durable(rows.withColumn("__bucket", F.substring("__draw", 1, 3)), "sizes")
    buckets = durable(rows.groupBy("source", "__bucket").agg(F.sum("size").alias("n")), "bucket_sizes")
    sources = durable(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), "source_sizes")
    plan = water_fill(cyclic_weights(sources, weights), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).drop("weight")
    ahead = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # 4096 rows a source at most
    before = buckets.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    before = durable(before.join(plan, before["source"].eqNullSafe(plan["source"])).drop(plan["source"]).drop("n"), "plan")
    inside = W.partitionBy("source", "__bucket").orderBy("__draw", "doc_id", "size", "__tie").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    b = before.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "source_size", "target", "whole", "rest", "before")
    out = out.join(b, out["source"].eqNullSafe(b["__s"]) & (out["__bucket"] == b["__b"]))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("__inside")))
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"))


def mix_sql(weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, docs: str = "documents", extra: str = "") -> str:
    """The same in DuckDB SQL: the clamped sources are those with the least clamp by weight, found from running sums."""
    listed = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    return rf"""
WITH sizes AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, ([{listed}])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)})::INT] AS weight,
         source_size * {float(max_epochs)}::DOUBLE AS cap
  FROM sources),
running AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS taken, sum(weight) OVER after AS left_weight,
         {float(share)}::DOUBLE * sum(source_size) OVER () AS total
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
plan AS (
  SELECT source, source_size, CASE WHEN weight * unit < cap THEN weight * unit ELSE cap END AS target
  FROM weighed, (SELECT (SELECT (total - taken) / left_weight FROM running WHERE (total - taken) / left_weight * weight < cap
                         ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS unit)),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan),
placed AS (
  SELECT s.*, p.source_size, p.target, p.whole, floor(p.target - p.whole * p.source_size)::BIGINT AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sizes s JOIN split p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, {extra} size, source_size, target, (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken
FROM placed"""
