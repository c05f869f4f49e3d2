"""The index and the cut of later repeats against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import substring_dedup
from offerloom.llm.fm_index import FmIndex

from .test_llm import DOCS, documents, words

MOST = np.iinfo(np.int64).max


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    letters, depth = int(rng.integers(1, 6)), int(rng.integers(1, 9))
    texts = [rng.integers(0, letters, rng.integers(0, 30)).astype(np.uint64) * np.uint64(7) for _ in range(rng.integers(1, 8))]
    weights = rng.integers(0, 100, len(texts))
    queries = [rng.integers(0, letters + 1, rng.integers(0, 30)).astype(np.uint64) * np.uint64(7) for _ in range(5)] + texts
    for q, length, least in zip(queries, *FmIndex(texts, weights, depth).matches(queries)):
        for i in range(len(q)):
            most, low = 0, MOST
            for t, w in zip(texts, weights):
                for j in range(len(t)):
                    k = 0
                    while k < depth and i + k < len(q) and j + k < len(t) and q[i + k] == t[j + k]:
                        k += 1
                    most, low = max(most, k), min(low, w) if k == depth else low
            assert (length[i], least[i]) == (most, low)


def brute(rows, window=50):
    """``(n_words, spans, kept)`` of each row of ``(doc_id, text)``."""
    split = [(t or "").encode().split() for _, t in rows]
    first = {}
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for i, own in enumerate(split):
        for k in range(len(own) - window + 1):
            w = tuple(own[k : k + window])
            first[w] = min(first.get(w, (True, MOST)), order(i))
    out = []
    for i, own in enumerate(split):
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append((rows[i][0], len(own), len(gone), b" ".join(w for k, w in enumerate(own) if k not in gone).decode()))
    return sorted(out, key=str)


def run(df, window=50):
    rows = substring_dedup.without_later(df, window).collect()
    for r in rows:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


def mixed():
    rng = random.Random(51)
    passages = [words(rng, n) for n in (49, 50, 51, 75, 120, 300)]
    texts = [f"{words(rng, rng.randint(0, 60))} {' '.join(rng.sample(passages, rng.randint(0, 3)))} {words(rng, rng.randint(0, 60))}" for _ in range(60)]
    hot = [f"{words(rng, rng.randint(0, 9))} {passages[4]} {words(rng, rng.randint(1, 9))}" for _ in range(60)]
    texts += hot + ["a " * 130, "a " * 60, "a b " * 80, "b a\n" * 70, texts[0], texts[0].replace(" ", "\t "), None, "", "  ", "x" * 100_000, words(rng, 6000), f"{words(rng, 30)} {texts[3]} {texts[4]} {texts[3]}"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(3, texts[4]), (3, texts[4]), (None, texts[2]), (None, texts[2]), (None, None), (-5, texts[7])]


@pytest.mark.parametrize("large, shard", [(1024, 1 << 18), (3, 500)])
def test_by_windows(spark, monkeypatch, large, shard):
    monkeypatch.setattr(substring_dedup, "LARGE", large)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rows = mixed()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumns({c: F.lit(1) for c in ("h", "u", "t", "r", "id0", "spans", "kept")})
    assert run(df) == brute(rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_many_equal_rows(spark):
    text = words(random.Random(52), 130)
    df = spark.range(20_000).selectExpr("id % 2 AS doc_id").withColumn("text", F.lit(text))
    got = substring_dedup.without_later(df).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 10_000), (1, 130, 10_000)]


def test_no_rows(spark):
    assert substring_dedup.without_later(documents(spark, ["x"]).filter("doc_id < 0")).count() == 0
