"""A Merkle manifest of a dataset, by an associative sparse forest.

A partition of rows in order knows the digests of its own nodes only. It holds them as a *forest*: unresolved nodes keyed by tree, level and
index. The arity of each run of siblings is known beforehand from the size of its tree, so a run that is complete becomes its parent at once, and
what is left of a contiguous range is a few nodes at its borders, whatever its length. Forests merge by union followed by the same step; this is
associative, so neighbouring partitions are merged in a tree of rounds until the root alone is left. Each resolved run is written down, and the
proofs are read off the runs from the root downwards, a level at a time: a run has at most ``FANOUT`` children, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Children of one run
FANOUT = 16
#: Fragments merged by one task of a round
MERGE = 16
#: The tree whose leaves are the roots of the others
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "kind string, part long, tree long, n long, level int, idx long, digests string"


def leaf(columns: list) -> F.Column:
    """SHA-256 of the fields, each its UTF-8 length, a colon and the value, or ``-`` for null."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields), 256)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` written in the order of ``order``, with ``part`` (which range a row lies in) and ``g``, its place from 0, over all ranges.

    Ranges are cut by sampled keys, so that no task holds more than its share; only a count for each range is ordered in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = durable(ranged.withColumn("part", F.spark_partition_id().cast("long")).withColumn("mono", F.monotonically_increasing_id()), name)
    counts = ranged.groupBy("part").agg(F.count("*").alias("k"), F.min("mono").alias("least"))  # one row for each range
    before = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    return ranged.join(F.broadcast(counts), "part").withColumn("g", F.col("before") + F.col("mono") - F.col("least")).drop("mono", "k", "least", "before")


class Forest:
    """Unresolved nodes of trees of known sizes; a run of siblings that is complete becomes its parent. ``add`` in any order gives the same."""

    def __init__(self, sources: int):
        self.sources = sources
        self.open: dict[tuple[int, int, int, int], dict[int, str]] = {}
        self.done: list[tuple[str, int, int, int, int, str]] = []

    def add(self, tree: int, n: int, level: int, idx: int, digest: str) -> None:
        while True:
            size = -(-n // FANOUT**level)
            if size == 1 and tree == TOP:
                self.done.append(("root", tree, n, level, idx, digest))
                return
            if size == 1:  # the root of a source is a leaf of the tree above
                tree, n, level, idx = TOP, self.sources, 0, tree
                continue
            key = (tree, n, level, idx // FANOUT)
            run = self.open.setdefault(key, {})
            run[idx] = digest
            if len(run) < min(FANOUT, size - FANOUT * key[3]):
                return
            del self.open[key]
            children = "".join(run[i] for i in sorted(run))
            self.done.append(("run", tree, n, level, key[3], children))
            level, idx, digest = level + 1, key[3], sha256(children.encode()).hexdigest()

    def rows(self, final: bool) -> list[tuple]:
        """Runs resolved since the last call, and with ``final`` what stays open."""
        out, self.done = self.done, []
        if final:
            out += [("open", *key[:3], i, digest) for key, run in self.open.items() for i, digest in run.items()]
        return out


def _batch(rows: list[tuple], part: int) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["kind", "tree", "n", "level", "idx", "digests"])
    df.insert(1, "part", part)
    return df


def _fragments(leaves: DataFrame, sources: int) -> DataFrame:
    """Each range of ``leaves(part, tree, n, idx, leaf)`` as its forest's open nodes and resolved runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, forest = None, Forest(sources)
        for batch in batches:
            for p, *node in zip(*(batch.column(c).to_pylist() for c in ("part", "tree", "n", "idx", "leaf"))):
                if p != part:
                    if part is not None:
                        yield _batch(forest.rows(True), part)
                    part, forest = p, Forest(sources)
                tree, n, idx, digest = node
                forest.add(tree, n, 0, idx, digest)
            yield _batch(forest.rows(False), part or 0)
        if part is not None:
            yield _batch(forest.rows(True), part)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in run(batches):
            if len(df):
                yield pa.RecordBatch.from_pandas(df, preserve_index=False, schema=pa.schema([("kind", pa.string()), ("part", pa.int64()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digests", pa.string())]))

    return leaves.mapInArrow(arrow, NODE)


def forest_runs(leaves: DataFrame, parts: int, sources: int) -> DataFrame:
    """All resolved runs ``(kind, part, tree, n, level, idx, digests)`` and the one row of kind ``root``.

    Fragments of ``MERGE`` neighbouring ranges merge in each round, so that only nodes at the borders of ranges travel.
    """

    def merge(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(sources)
        for row in nodes[["tree", "n", "level", "idx", "digests"]].itertuples(index=False):
            forest.add(*row)
        return _batch(forest.rows(True), int(key[0]))

    level = durable(_fragments(leaves, sources), "fragments")
    out = level.filter("kind <> 'open'")
    while parts > 1:
        parts = -(-parts // MERGE)
        merged = level.filter("kind = 'open'").withColumn("next", F.expr(f"part div {MERGE}")).groupBy("next").applyInPandas(merge, NODE)
        level = durable(merged, "merged")
        out = out.union(level.filter("kind <> 'open'"))
    return out


def _step(digests, pos) -> F.Column:
    """What stands left and right of the child ``pos`` in a run's digests."""
    return F.struct(F.substr(digests, F.lit(1), pos * 64).alias("l"), F.substr(digests, pos * 64 + 65).alias("r"))


def _depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _below(own: DataFrame, above: DataFrame) -> DataFrame:
    """``own(tree, n, idx, digests)`` with the ``path`` of each run: the step at its parent, a run of ``above``, and that one's path."""
    above = above.select(F.col("tree").alias("at"), F.col("idx").alias("up"), F.col("digests").alias("d"), "path")
    step = _step(F.col("d"), F.expr(f"cast(idx % {FANOUT} AS int)"))
    joined = own.join(above, (F.col("tree") == F.col("at")) & (F.expr(f"idx div {FANOUT}") == F.col("up")))
    return joined.select("tree", "n", "idx", "digests", F.concat(F.array(step), "path").alias("path"))


def _paths(runs: DataFrame, trees: DataFrame, sources: int, largest: int) -> DataFrame:
    """``(tree, n, idx, digests, path)`` for each run of leaves: its children, and the steps from its parent up to the root.

    A source of one leaf has no run; it gets a row without digests.
    """
    none = F.expr("cast(array() AS array<struct<l: string, r: string>>)")
    at = lambda level, top: runs.filter((F.col("level") == level) & ((F.col("tree") == TOP) == top)).select("tree", "n", "idx", "digests")
    top = None
    for level in reversed(range(_depth(sources))):
        top = at(level, True).withColumn("path", none) if top is None else _below(at(level, True), top)
    roots = trees.select(F.lit(TOP).cast("long").alias("tree"), "n", F.col("tree").alias("idx"), F.lit(None).cast("string").alias("digests"))
    roots = roots.withColumn("path", none) if top is None else _below(roots, top)
    roots = durable(roots.select(F.col("idx").alias("tree"), "n", F.lit(0).cast("long").alias("idx"), "digests", "path"), "roots")
    up = None
    for level in reversed(range(_depth(largest))):
        own = at(level, False)
        low, high = FANOUT**level, FANOUT ** (level + 1)  # the last run of trees of this size is their root
        ends = own.filter(f"n > {low} and n <= {high}").join(roots.select("tree", "path"), "tree").select("tree", "n", "idx", "digests", "path")
        up = ends if up is None else ends.unionByName(_below(own.filter(f"n > {high}"), up))
        up = durable(up, "paths")
    alone = roots.filter("n = 1")
    return alone if up is None else up.unionByName(alone)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", order: str = "doc_id", tampered: dict | None = None) -> DataFrame:
    """Leaf, source root, root and proof of each row of ``docs``, and whether the row as it is now leads to the root.

    Leaves of a source ascend by ``order`` (nulls first, equal ones by their digests); sources ascend too, null first. ``tampered`` maps
    fields to expressions of a changed row: ``folded_root`` starts from its leaf. Columns: ``order``, ``leaf, subroot, root, proof_sha256,
    folded_root, verified``. Rows that repeat are leaves of their own; an empty table gives no rows; other columns are not read.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    changed = columns | (tampered or {})
    rows = docs.select(F.col(f"`{order}`").alias("id"), F.col(f"`{source}`").cast("string").alias("src"), leaf(list(columns.values())).alias("leaf"), leaf(list(changed.values())).alias("now"))
    rows = numbered(rows, [F.col("src").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("now")], "leaves")
    per = durable(rows.groupBy("src").agg(F.min("g").alias("base"), F.count("*").alias("n")), "sources")
    size = per.agg(F.count("*").alias("sources"), F.max("n").alias("largest")).first()
    trees = durable(numbered(per, [F.col("src").asc_nulls_first()], "ordered").select(F.col("src").alias("own"), F.col("g").alias("tree"), "base", "n"), "trees")
    leaves = rows.join(trees, F.col("src").eqNullSafe(F.col("own"))).select("part", "id", "leaf", "now", "tree", "n", "g", (F.col("g") - F.col("base")).alias("idx"))
    leaves = durable(leaves.repartition("part").sortWithinPartitions("part", "g"), "indexed")
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    resolved = durable(forest_runs(leaves, parts, size.sources), "resolved")
    root = resolved.filter("kind = 'root'").first()  # one row, none for an empty table
    root = F.lit(root and root.digests).cast("string")
    runs = resolved.filter("kind = 'run'").select("tree", "n", "level", "idx", "digests")
    paths = _paths(runs, trees, size.sources, size.largest or 0)
    top = runs.filter(F.col("tree") == TOP).filter("level = 0").select(F.col("idx").alias("r"), F.col("digests").alias("roots"))
    subroot = trees.join(top, F.expr(f"tree div {FANOUT}") == F.col("r"), "left")
    subroot = subroot.select(F.col("tree").alias("t"), F.coalesce(F.expr(f"substring(roots, cast(tree % {FANOUT} AS int) * 64 + 1, 64)"), root).alias("subroot"))
    paths = paths.join(subroot, F.col("tree") == F.col("t")).select(F.col("tree").alias("t"), F.col("idx").alias("r"), "digests", "path", "subroot")
    own = F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.concat(F.array(_step(F.col("digests"), F.expr(f"cast(idx % {FANOUT} AS int)"))), "path"))
    proven = leaves.join(paths, (F.col("tree") == F.col("t")) & (F.expr(f"idx div {FANOUT}") == F.col("r"))).withColumn("steps", own)
    siblings = F.sha2(F.array_join(F.transform("steps", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    folded = F.aggregate("steps", F.col("now"), lambda digest, x: F.sha2(F.concat(x["l"], digest, x["r"]), 256))
    out = proven.select(F.col("id").alias(order), "leaf", "subroot", root.alias("root"), siblings.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
