"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from offerloom.llm import manifest

from .test_llm import DOCS

FANOUT = 16


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return digest(*(field(row[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        start = i // FANOUT * FANOUT
        out.append((nodes[start:i], nodes[i + 1 : start + FANOUT]))
        i //= FANOUT
    return out


def tampered(row):
    if row["doc_id"] is None or row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 5:
        return row
    return row | {"text": "".join(c.lower() if c in string.ascii_uppercase else c for c in row["text"])}


def brute(rows):
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in names}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            proof = siblings(trees[s], i) + siblings(top, k)
            now = leaf(tampered(r))
            for left, right in proof:
                now = digest(*left, now, *right)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], digest(*(x for step in proof for side in step for x in side)), now, now == top[-1][0]))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def run(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    return by_id(tuple(r) for r in manifest.manifest(df, tampered={"text": text}).collect())


def mixed():
    rng = random.Random(31)
    rows = [(None, None, None, None, None), (1, "AB", "x", "a", None), (1, "AB", "x", "a", None), (1, "AB", "x", "a", 2), (2, "Z" * 200_000, "x", "a", 2)]
    rows += [(i, "É à B", "", f"s{i}", 0) for i in range(300)]
    return rows + [(rng.randint(0, 99_999), "Xy", "e", rng.choice([None, "hot", "hot", "hot", "z", "é", "ZZ"]), 3) for _ in range(5000)]


@pytest.mark.parametrize("cut", [slice(None), slice(0), slice(1), slice(1, 2), slice(1, 4), slice(5, 25)])
def test_mixed_rows(spark, cut):
    rows = mixed()[cut]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(0) for c in ("g", "part", "tree", "leaf", "n", "idx", "src", "id")})
    assert run(df) == by_id(brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]))


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(df) == by_id(brute([r.asDict() for r in df.collect()]))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4097])
def test_forests_merge_in_any_order(n):
    rng = random.Random(n)
    nodes = [digest(str(i)) for i in range(n)]
    parts = [list(enumerate(nodes))[at : at + 7] for at in range(0, n, 7)]
    rng.shuffle(parts)
    while True:
        merged = []
        for at in range(0, len(parts), 3):
            forest = manifest.Forest(1)
            for item in (x for p in parts[at : at + 3] for x in p):
                forest.add(0, n, *item) if len(item) == 3 else forest.add(0, n, 0, *item)
            rows = forest.rows(True)
            roots = [r[-1] for r in rows if r[0] == "root"]
            merged.append([(r[3], r[4], r[5]) for r in rows if r[0] == "open"])
        parts = merged
        if roots or len(parts) == 1:
            break
    assert roots == [levels(nodes)[-1][0]]
