"""From raw documents to a training mix: five stages, each one operator of the library applied to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerloom.llm import decontam, jaccard, mixing, quality, simhash, suffix_dedup
from offerloom.llm.common import durable


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A row is judged by its own text and metadata, whatever its ``doc_id``: rows that repeat and rows that tie share their fate. Null and empty texts are scored as texts without
    words; very long ones count whole. Nulls in other columns are values of their own. An empty table stays empty.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    SimHash takes the copies that differ in next to nothing; documents left that share 0.8 or more of their five-word shingles go next. Texts without words, null ones too, are
    copies of one another. Of rows equal in ``doc_id`` and text one stays, the least by its other columns; a row that only shares its ``doc_id`` with a copy stays, and so does
    one without ``doc_id``. Texts of any length are compared whole. An empty table stays empty.
    """
    left = durable(simhash.drop_near_copies(docs, size=3, radius=2), "simhash")
    return jaccard.drop_similar(left, size=5, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and any of 400 bytes or more, that occur elsewhere too are cut out; every document stays.

    All places of a passage go, in the row itself too, so rows that repeat lose the whole of it; none is first. A null text comes back empty, and an empty or short one as it was. Very long
    texts are taken in overlapping stretches. An empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs, depth=400, words=51)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    A row is judged by its own text, whole, so rows that repeat go or stay together, whatever their ``doc_id``. Null and empty texts stay. An empty table on either side changes nothing.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words taken of each (repeats counted) and what its source has and should give.

    Documents of which nothing is taken are not in it: texts without words, null ones too, and those that a source's fraction passes over. A null source is one of its own. Rows that repeat
    count each; ties in the drawn order go by id, size and text. An empty table gives no rows.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    return mixing.mix(docs, weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0, keep=keep).filter("taken > 0")


STAGES = [
    ("quality classifier", drop_bad),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]
#: SimHash, co-training and byte-wise suffixes have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents`` of ``sf_dir``. What a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
