"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most ``radius`` bits agree wholly on at least one of ``radius + 1`` blocks of bits. That routes
each distinct fingerprint to ``radius + 1`` buckets, and a bucket with too many of them is split again on its remaining bits by
the same argument, so no bucket outgrows a task. Within a bucket the fingerprints stand in Gray order, neighbours share long
bit patterns, and a tree is built over them: each node keeps the pattern that all below it share. A search of the tree against
itself adds up the differing bits on the way down and drops a pair of groups as soon as the sum exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, durable, without_rows

FANOUT = 4
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_bounds(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (a run without space, 09-0D) of ``data`` starts and ends."""
    x = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], (x != 32) & ((x < 9) | (x > 13)), [False]))
    return np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])


def shingles(data: bytes | None, size: int, step: int = 16_384) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in their order, with repeats, ``step`` or fewer words at a time."""
    import xxhash

    data = (data or b"").lower()
    h = xxhash.xxh64_intdigest
    if len(data) <= 4 * step:
        parts = [data]
    else:  # a long text is never held as a list of all its words
        opens, closes = word_bounds(data)
        last = max(1, len(opens) - size + 1)
        parts = (data[opens[at] : closes[min(at + step + size - 1, len(opens)) - 1]] for at in range(0, last, step)) if len(opens) else []
    for part in parts:
        words = part.split()
        if len(words) <= size:
            if words:
                yield np.array([h(b" ".join(words), 42)], np.uint64)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
        yield np.array([h(joined[s:e], 42) for s, e in zip(first, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(data: bytes | None, size: int = 3) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned number: a bit is set if it is set in over half the shingles' hashes.

    A-Z become lower case; words are runs without white space (space, 09-0D); shingles are ``size`` words joined by a space, with
    repeats. Fewer words give one shingle, none (or null) gives zero.
    """
    n, counts = 0, np.zeros(64, np.int64)
    for hashes in shingles(data, size):
        n += len(hashes)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, th long, fp long)`` for every row of ``docs``; other columns are not read. A null text counts as an empty one.

    ``th`` hashes the text: with ``doc_id`` it names a row where ids repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(x.as_py(), size) for x in part.column("t")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(found)], names=["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def merge(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of ``n`` nodes after joining the pairs ``(a, b)``: the smallest node of each component."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while not (label == (up := label[label])).all():
            label = up


def gray_groups(codes: np.ndarray, group: np.ndarray, radius: int, step: int = 1 << 13) -> np.ndarray:
    """Labels of the components that links of at most ``radius`` bits make within each group.

    ``codes`` stand in Gray order within contiguous groups. A level's node covers up to ``FANOUT`` nodes of the level below;
    ``alike`` are the bits on which all codes under it agree and ``bits`` their values.
    """
    n = len(codes)
    levels, low, high, of = [], codes, codes, group
    first = None
    while True:
        levels.append((~(low ^ high), low, first))
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        if len(starts) == len(of):
            break
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
        first = np.flatnonzero(place % FANOUT == 0)
        low, high, of = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), of[first]
        first = np.append(first, len(place))
    label = np.arange(n)
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top, np.zeros(len(top), np.int64), np.zeros(len(top), np.uint64))]
    while stack:
        level, a, b, total, counted = stack.pop()
        if len(a) > step:
            stack += [(level, a[i : i + step], b[i : i + step], total[i : i + step], counted[i : i + step]) for i in range(0, len(a), step)]
            continue
        alike, bits, first = levels[level]
        fresh = alike[a] & alike[b] & ~counted
        total = total + np.bitwise_count((bits[a] ^ bits[b]) & fresh)
        near = total <= radius
        if level == 0:
            near &= a < b
            label = merge(n, a[near], b[near], label)
            continue
        a, b, total, counted = a[near], b[near], total[near], (counted | fresh)[near]
        ca, cb = first[a][:, None] + np.arange(FANOUT), first[b][:, None] + np.arange(FANOUT)
        x, y = np.repeat(ca, FANOUT, axis=1), np.tile(cb, FANOUT)
        keep = (x < first[a + 1][:, None]) & (y < first[b + 1][:, None]) & (x <= y)
        at = np.nonzero(keep)[0]
        stack.append((level - 1, x[keep], y[keep], total[at], counted[at]))
    return label


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    """``free`` bit places cut into ``parts`` runs of nearly equal length."""
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:])]


def _paths(parts: int, depth: int, free: list[int], used: tuple[int, ...] = ()) -> dict[tuple[int, ...], list[int]]:
    """For each way down the block tree, the bits that its bucket key fixes."""
    out = {}
    for i, block in enumerate(_blocks(free, parts)):
        path = (*used, i)
        out[path] = block
        if depth > 1:
            out |= {k: block + v for k, v in _paths(parts, depth - 1, [x for x in free if x not in block], path).items()}
    return out


def links(distinct: DataFrame, radius: int = 2, bucket: int = 4096, depth: int = 3, held: Scratch | None = None) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints of ``distinct(fp)`` that span the same components as all pairs within ``radius``.

    A bucket holds the fingerprints that agree on one block of bits. One with more than ``bucket`` of them is dealt out again on
    the bits left, ``depth`` times at most; a bucket at the last level shares at least 45 of 64 bits. ``held`` takes the tables made on the way.
    """
    held = held or Scratch()
    parts = radius + 1
    paths = _paths(parts, depth, list(range(64)))
    mask = {p: (m if m < 1 << 63 else m - (1 << 64)) for p, m in ((p, sum(1 << x for x in v)) for p, v in paths.items())}
    number = {p: i for i, p in enumerate(paths)}
    waiting = distinct.select("fp", F.array(*[F.struct(F.lit(number[(i,)]).alias("path"), F.col("fp").bitwiseAND(F.lit(mask[(i,)])).alias("key")) for i in range(parts)]).alias("k")).select("fp", F.inline("k"))
    ready = None
    for level in range(1, depth + 1):
        if level == depth:
            ready = waiting if ready is None else ready.union(waiting)
            break
        table = held(waiting, f"buckets{level}")
        large = held(table.groupBy("path", "key").count().filter(F.col("count") > bucket).select("path", "key"), f"large{level}")
        if large.isEmpty():
            ready = table if ready is None else ready.union(table)
            break
        small = table.join(large, ["path", "key"], "left_anti").select("fp", "path", "key")
        ready = small if ready is None else ready.union(small)
        down = F.lit(None).cast("array<struct<path:int,key:bigint>>")
        for p in (p for p in paths if len(p) == level):
            down = F.when(F.col("path") == number[p], F.array(*[F.struct(F.lit(number[(*p, i)]).alias("path"), F.col("fp").bitwiseAND(F.lit(mask[(*p, i)])).alias("key")) for i in range(parts)])).otherwise(down)
        waiting = table.join(large, ["path", "key"], "left_semi").select("fp", down.alias("k")).select("fp", F.inline("k"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            codes = rows["fp"].to_numpy().view(np.uint64)
            key = rows["path"].to_numpy().astype(np.int64), rows["key"].to_numpy()
            order = np.lexsort((gray_rank(codes), key[1], key[0]))
            codes, path, key = codes[order], key[0][order], key[1][order]
            group = np.cumsum(np.concatenate(([0], (path[1:] != path[:-1]) | (key[1:] != key[:-1]))))
            label = gray_groups(codes, group, radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[label[linked]].view(np.int64)})

        kept: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            kept.append(pdf)
            n += len(pdf)
            if n >= 2 * bucket:
                rows = pd.concat(kept, ignore_index=True)
                last = rows.iloc[-1]
                tail = ((rows["path"] == last["path"]) & (rows["key"] == last["key"])).to_numpy()
                cut = n - int(tail.sum())  # the rows are sorted by bucket
                if cut:
                    yield flush(rows.iloc[:cut])
                kept, n = [rows.iloc[cut:]], n - cut
        if n:
            yield flush(pd.concat(kept, ignore_index=True))

    return ready.repartition("path", "key").sortWithinPartitions("path", "key").mapInPandas(search, "a long, b long")


def _grouped(docs: DataFrame, size: int, radius: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """``fingerprints`` as a written table, and ``(fp, component)`` of each distinct one as another."""
    held = Scratch()
    fps = durable(fingerprints(docs, size), "fingerprints")
    distinct = held(fps.select("fp").distinct(), "distinct")
    of = components(links(distinct, radius, bucket, held=held))
    named = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))
    named = durable(named, "named")
    held.drop()
    return fps, named


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 2, bucket: int = 4096) -> DataFrame:
    """``(doc_id, fp long, component_id)`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest ``doc_id``
    reachable, itself included. Equal fingerprints are one node, so copies are never paired. A null or empty text has the
    fingerprint zero and links like any other. Rows with a null ``doc_id`` keep their row; they count for no minimum, and their
    component is null where no other document is in it. Rows that repeat a ``doc_id`` each get a row. An empty table gives none.
    """
    fps, named = _grouped(docs, size, radius, bucket)
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(named, "fp")
    first = low.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = durable(named.join(first, "component").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, size: int = 3, radius: int = 2, bucket: int = 4096) -> DataFrame:
    """``docs`` without all but one row of each group of :func:`simhash_groups`: the one with the smallest ``doc_id``, then text hash, stays.

    Columns are those of ``docs``. A row is known by its ``doc_id`` and text, so one that only shares its id with a near copy stays. Of rows
    equal in both one stays (:func:`common.without_rows`). Rows without a ``doc_id`` stay. Null and empty texts are one group. An
    empty table gives an empty one.
    """
    fps, named = _grouped(docs, size, radius, bucket)
    rows = fps.filter("doc_id IS NOT NULL")
    low = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("low")).join(named, "fp")
    first = low.groupBy("component").agg(F.min("low").alias("first")).join(named, "component").select("fp", "first")
    gone = rows.join(first, "fp").filter(F.struct("doc_id", "th") != F.col("first")).select("doc_id", "th")
    return without_rows(docs, durable(gone.distinct(), "gone"), rows.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th"))
