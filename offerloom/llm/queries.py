"""The queries of this subpackage and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, embed_dedup, licenses, manifest, mixing, quality, simhash, substring_dedup, suffix_dedup, tokens, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, with other numbers, names or units or without."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document covered by a 400-byte string that also starts elsewhere, a digest of the rest, and how much stands in passages of over 50 words that do."""
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), depth=400, words=51)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links at a cosine of 0.93 or more within its label, and its group."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's 3-word SimHash and its group by links of two bits or fewer."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each participant's view of each conversation, with what to learn from it."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to take of each document so that sources weighing 5, 2, 1 in turn share 150% of all words, twice each at most."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    return urls.judge(table(spark, sf_dir, "pages"), rules=urls.RULES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of each document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probability of being good, and whether to keep it."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document covered by 50 words in a row that start in an earlier document too, and a digest of the rest."""
    cut = substring_dedup.without_later(table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str, models: str = "/opt/tokenizers") -> DataFrame:
    """How the tokens of a byte-level BPE and of a piece model line up in each document, and which pairs of ids go together."""
    return align.align(table(spark, sf_dir, "documents"), f"{models}/byte_bpe_50k.json", f"{models}/piece_bpe_32k.model")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, proof and root, and whether it still proves the root after a fifth of the texts was put in lower case."""
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(struck, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered={"text": text})


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_simhash": op4_simhash,
    "op5_chat_format": op5_chat_format,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op5_chat_format": chat.rotate_sql(),
    "op6_mixing": mixing.mix_sql(),
    "op7_licenses": licenses.scan_sql(),
    "op8_url_filter": urls.judge_sql(),
}
