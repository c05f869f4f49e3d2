"""Near copies by the Jaccard similarity of their word shingles: MinHash buckets propose pairs, the shingles themselves decide.

Texts with the same set of shingles are one node. A node lies in ``BANDS`` buckets, by ``ROWS`` minimum hashes each; two nodes of
similarity 0.8 miss each other in all of them once in 300,000 pairs. Links join nodes to groups, and a pair within a group needs no look:

1. Chains: nodes of a bucket stand in a drawn order, cut into stretches of bounded length, and neighbours are compared. A second
   drawn order does the same where a bucket still holds several groups. That puts a large group of copies together with few pairs.
2. What is left of a bucket is held against its largest group: that group's nodes, dealt out in blocks, once for all buckets.
3. The nodes outside the largest groups are held against one another bucket by bucket, in blocks too.

Blocks are compared by their MinHashes first (a byte of each); pairs that could be similar by them are compared by their shingles,
unless they are in one group by then. No pair has a row of its own, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, durable, without_rows
from .simhash import shingles

BANDS, ROWS = 24, 4
#: Equal bytes of two signatures from which on a pair is compared: at a similarity of 0.8 fewer come up once in 10**11 pairs.
LIKELY = 50
#: Nodes, and shingles, that a block holds
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
_RNG = np.random.default_rng(80_021)
TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).view(np.uint64)
FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none for a text without words."""
    found = [np.unique(x) for x in shingles(data, size)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bucket of each band for a set of hashes, and a byte of each minimum."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(low, (found[at : at + 2048, None] * TIMES + PLUS).min(axis=0), out=low)
    h = (low.reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    mixed = low * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))).view(np.int64), (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, th, node, n, sig, keys)`` of each row with a ``doc_id`` and a word; ``th`` hashes the text as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                rows: list[tuple] = []
                for i, th, t in pdf.iloc[at : at + 1024].itertuples(index=False):
                    found = shingle_set(t, size)
                    if len(found):
                        keys, sig = bands(found)
                        rows.append((i, th, np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64), len(found), sig, keys))
                yield pd.DataFrame(rows, columns=["doc_id", "th", "node", "n", "sig", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t"))
    return own.mapInPandas(run, f"doc_id {kind}, th long, node long, n long, sig binary, keys array<long>")


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if least * max(len(x), len(y)) > min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(node, s)``: the set of shingles of each of ``wanted(node)``, once."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                own = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"node": own["node"], "s": [shingle_set(t, size).tobytes() for t in own["t"]]})

    first = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("node", "r.*")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t"))
    return texts.join(first, ["doc_id", "th"]).select("node", "t").mapInPandas(sets, "node long, s binary").dropDuplicates(["node"])


def _chain(shared: DataFrame, seed: int, stretch: int = 512) -> DataFrame:
    """Distinct neighbours ``(a, b)`` of different groups in the drawn order of each bucket of ``shared(key, node, m, c)``.

    A bucket of ``m`` nodes is cut into stretches of that order, of about ``stretch`` nodes each. The order is the same in all buckets,
    so that neighbours that share many buckets are one pair.
    """
    drawn = F.xxhash64("node", F.lit(seed))
    place = F.floor((drawn / float(1 << 64) + 0.5) * F.ceil(F.col("m") / stretch)).cast("long")
    by = Window.partitionBy("key", "part").orderBy("drawn", "node")
    rows = shared.withColumn("drawn", drawn).withColumn("part", place)
    rows = rows.select("node", "c", F.lag("node").over(by).alias("before"), F.lag("c").over(by).alias("d"))
    return rows.filter("c <> d").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a similarity of ``least`` or more."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(pdf["sa"], pdf["sb"])]
            yield pdf.loc[ok, ["a", "b"]]

    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.mapInPandas(compare, "a long, b long")


def _blocks(n: str = "rows", total: str = "total") -> F.Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(total) / BLOCK_SHINGLES)).cast("int")


def _tiles(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(cell, tile, held, node, c)``: what to compare of the buckets ``rest(key, node, c, n)``; rows of a tile that are not held meet those that are.

    A bucket's largest group has cells of its own, shared by all buckets; the other nodes of a bucket make a cell.
    """
    by_group = rest.groupBy("key", "c").agg(F.count("*").alias("k"))
    top = by_group.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("top"))
    marked = rest.join(top, "key")
    others = marked.filter("c <> top")

    guests = others.select(F.col("top").alias("cell"), "node", "c").distinct()
    homes = sizes.join(guests.select(F.col("cell").alias("c")).distinct(), "c", "left_semi")
    blocks = homes.groupBy("c").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).select(F.col("c").alias("cell"), _blocks().alias("blocks"))
    home = homes.join(blocks, homes["c"] == blocks["cell"]).select("cell", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("tile"), F.lit(True).alias("held"), "node", "c")
    away = guests.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("tile"), F.lit(False).alias("held"), "node", "c")

    split = others.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("total")).filter("low < high")
    inner = others.select("key", "node", "c").join(split.select("key", _blocks().alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a node is held in the tile of its own block and met there by the nodes of later blocks
    inner = inner.select(F.xxhash64("key", F.lit("bucket")).alias("cell"), F.explode(F.sequence(F.lit(0), "own")).alias("tile"), "own", "node", "c")
    inner = inner.select("cell", "tile", (F.col("own") == F.col("tile")).alias("held"), "node", "c")
    return home.unionByName(away).unionByName(inner)


def _search(tiles: DataFrame, sets: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` that join groups within each tile."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, up, links = None, {}, []
        base: list[tuple] = []  # (node, c, set) of the rows held
        marks: list[np.ndarray] = []

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def meet(node: int, c: int, sig: np.ndarray, own: np.ndarray, among: np.ndarray) -> None:
            equal = (among == sig).sum(axis=1)
            some = np.flatnonzero(equal >= LIKELY)
            for j in some[np.argsort(-equal[some], kind="stable")]:
                other, d, theirs = base[j]
                if root(d) != root(c) and _alike(own, theirs, least):
                    up[root(d)] = root(c)
                    links.append((other, node))

        for pdf in batches:
            for cell, tile, held, node, c, sig, s in pdf[["cell", "tile", "held", "node", "c", "sig", "s"]].itertuples(index=False):
                if (cell, tile) != at:
                    at, up, base, marks = (cell, tile), {}, [], []
                sig, own = np.frombuffer(sig, np.uint8), np.frombuffer(s, np.uint64)
                if base and (not held or c != base[0][1] or c != base[-1][1]):  # rows held come first, those of a group side by side
                    if len(marks) > 1:
                        marks = [np.vstack(marks)]
                    meet(node, c, sig, own, marks[0])
                if held:
                    base.append((node, c, own))
                    marks.append(sig[None, :])
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
            links = []

    rows = tiles.join(sets, "node").join(signatures, "node").select("cell", "tile", "held", "node", "c", "sig", "s")
    return rows.repartition("cell", "tile").sortWithinPartitions("cell", "tile", F.desc("held"), "c").mapInPandas(compare, "a long, b long")


def _joined(of: DataFrame, links: DataFrame, held: Scratch) -> DataFrame:
    """``of(node, component)`` with ``links(a, b)`` added: only the components that these join are solved, not all links anew."""
    ends = links.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left")
    up = held(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "joined")
    old = of.join(up.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return old.union(up.join(of, "node", "left_anti").select("node", "component"))


def drop_similar(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without all but one row of each group: the one with the smallest ``doc_id``, then text hash, stays.

    Documents link when the sets of their ``size``-word shingles (as in :func:`simhash.fingerprint`) have a Jaccard similarity of
    ``least`` or more, 0.8 at least for the recall above. Columns stay. Of rows equal in ``doc_id`` and text one stays. Rows without a ``doc_id`` or
    without words stay. An empty table gives an empty one.
    """
    held = Scratch()
    nodes = held(_nodes(docs, size), "minhash")
    distinct = held(nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "nodes")
    spread = distinct.select("node", F.explode("keys").alias("key"))
    many = spread.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = held(spread.join(many, "key").select("key", "node", "m"), "buckets")
    sets = held(_sets(shared.select("node").distinct(), nodes, docs, size), "shingles")

    of = held(components(held(_similar(_chain(shared.withColumn("c", F.col("node")), 0), sets, least), "chain")), "groups")
    for step in ("order", "blocks"):
        rest = shared.join(of, "node", "left").select("key", "node", "m", F.coalesce("component", "node").alias("c"))
        split = rest.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).filter("low < high")
        if step == "order":
            found = _similar(_chain(held(rest.join(split.filter("k > 2").select("key"), "key", "left_semi"), "rest"), 1), sets, least)
        else:
            rest = held(rest.join(split.select("key"), "key", "left_semi").join(distinct.select("node", "n"), "node"), "split")
            sizes = distinct.select("node", "n").join(of, "node", "left").select(F.coalesce("component", "node").alias("c"), "node", "n")
            found = _search(_tiles(rest, sizes), sets, distinct.select("node", "sig"), least)
        found = held(found, step)
        if not found.isEmpty():
            of = held(_joined(of, found, held), "groups")

    named = nodes.join(of, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("c"))
    low = named.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("low"), F.count("*").alias("k")).filter("k > 1").select("c", "low")
    gone = durable(named.join(low, "c").filter(F.struct("doc_id", "th") != F.col("low")).select("doc_id", "th").distinct(), "gone")
    repeated = durable(nodes.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th"), "twice")
    held.drop()
    return without_rows(docs, gone, repeated)
