"""Chat formatting by rotation: each participant's view of a dialogue, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

END = "<|end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, speaker, text)`` with ``pos``, the place within the conversation from 0.

    Order: turn (null last), speaker, text; rows that repeat stand side by side. The rows are dealt out by ranges of that order, so a
    conversation of any length is numbered by many tasks: each counts its own rows and adds those of earlier ranges.
    """
    spark = turns.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = durable(turns.withColumn("__id", F.monotonically_increasing_id()), "turns")
    order = [F.col("conv_id"), F.col("turn").isNull(), "turn", "speaker", F.col("text"), "__id"]
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    held = dealt.groupBy("conv_id", "__part").count()
    before = W.partitionBy("conv_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    held = held.select(F.col("conv_id").alias("__c"), F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    own = dealt.withColumn("__own", F.row_number().over(W.partitionBy("__part", "conv_id").orderBy(*order)) - 1)
    own = own.join(held, own["conv_id"].eqNullSafe(held["__c"]) & (own["__part"] == held["__p"]))
    return own.select("conv_id", "turn", "speaker", "text", (F.col("__before") + F.col("__own")).alias("pos"))


def _plain(speaker):
    """A speaker's name within a mark: one line, without the signs that open and close marks."""
    return F.translate(F.regexp_replace(speaker, r"[\r\n]+", " "), "<|>", "(!)")


def rotate(conversations: DataFrame, chunk_turns: int | None = None) -> DataFrame:
    """``conv_id, perspective, chunk, n_turns, n_target_turns, rendered, mask``: a row for each participant's view.

    A participant is a distinct role but ``system``; a null or empty role is the speaker ``unknown``. In its view its own turns are
    the assistant's, other participants' are users' under their names, and system turns stay. ``mask`` lists the stretches of
    ``rendered`` to learn from, in characters, as ``start-stop`` joined by commas: the speaker's own words and end marks.
    A view is one row, ``chunk`` 0, however long the talk. ``chunk_turns`` cuts views into rows of that many turns, for talks that outgrow
    a row; later rows don't repeat what stands before. Marks within a text are
    defused (``<|`` becomes ``< |``), and the signs ``<|>`` of a name become ``(!)``, its line ends blanks. A null text is an empty one, a null ``conv_id`` one more conversation. A conversation of system turns alone has
    no view. An empty table gives none.
    """
    role = F.col("role").cast("string")
    speaker = F.when(role.isNull() | (role == ""), "unknown").otherwise(role)
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = durable(numbered(conversations.select("conv_id", "turn", speaker.alias("speaker"), text.alias("text"))), "numbered")
    views = turns.filter("speaker <> 'system'").select(F.col("conv_id").alias("__c"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(views, turns["conv_id"].eqNullSafe(views["__c"])).drop("__c")
    target = F.col("speaker") == F.col("perspective")
    head = F.when(target, "<|assistant|>\n").when(F.col("speaker") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), _plain("speaker"), F.lit("|>\n")))
    rows = rows.select("conv_id", "perspective", (F.floor(F.col("pos") / chunk_turns) if chunk_turns else F.lit(0).cast("long")).alias("chunk"), "pos", target.alias("target"), head.alias("head"), F.concat("text", F.lit(END)).alias("body"))
    w = W.partitionBy("conv_id", "perspective", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("head") + F.length("body")).over(w), F.lit(0)) + F.length("head")
    rows = rows.withColumn("span", F.when(F.col("target"), F.concat_ws("-", begin, begin + F.length("body"))))
    part = F.struct("pos", F.concat("head", "body").alias("piece"), "span")
    got = rows.groupBy("conv_id", "perspective", "chunk").agg(F.array_sort(F.collect_list(part)).alias("p"))  # the turns of a row
    return got.select(
        "conv_id", "perspective", "chunk", F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["span"].isNotNull())).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered"),
        F.array_join(F.transform("p", lambda x: x["span"]), ",").alias("mask"),
    )


def rotate_sql() -> str:
    """The same in DuckDB SQL."""
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, text) - 1 AS pos FROM turns),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
pieces AS (
  SELECT t.conv_id, perspective, 0::BIGINT AS chunk, pos, speaker = perspective AS target,
         CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || translate(regexp_replace(speaker, '[\r\n]+', ' ', 'g'), '<|>', '(!)') || '|>' || chr(10) END AS head,
         text || '<|end|>' || chr(10) AS body
  FROM placed t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
spans AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM pieces)
SELECT conv_id, perspective, chunk, count(*)::BIGINT AS n_turns, count(*) FILTER (target)::BIGINT AS n_target_turns,
       string_agg(head || body, '' ORDER BY pos) AS rendered,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY pos) FILTER (target), '') AS mask
FROM spans GROUP BY conv_id, perspective, chunk"""
