"""Repeated passages of words, kept where they stand first, by a compressed index a shard.

A *window* is ``window`` words in a row. It goes from every document that comes after the first one it starts in. Three steps find these:

1. Windows are routed by content. Each is filed under the least-hashed 16 words in it, its anchor, a choice that equal windows share; neighbours with the
   same anchor are one run. A run is a stretch of text, so equal windows meet whatever stands around them. Anchors of one document alone are done.
2. Runs that are equal as a whole are one *content*; it belongs to the first document that holds it, all later ones lose the run. So copies never
   reach the index more than once.
3. Contents that share an anchor but differ go to the shard of their anchor. A shard is an :class:`~.fm_index.FmIndex` over its contents, weighed by their
   documents; its contents are streamed through it, and an interval above the threshold in which an earlier document lies is a repeat.

The number of shards grows with the words to index, so a shard is bounded. An anchor with more than ``LARGE`` contents would outgrow its shard; its windows are
routed one by one, by their own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .fm_index import FmIndex
from .suffix_dedup import WORD_GRAM, coded, merged, pieces, rollers, runs_of

#: Words in a shard, about
SHARD = 1 << 18
#: Contents of an anchor that go to one shard together
LARGE = 1024
#: Ranks after every ``doc_id``
NO_ID = (1 << 63) - 1
KEY = ["id0", "th"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as ``(id0, th, t)``: the place in the order of documents, a hash of the text and its bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id0"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))


def _runs(keys: DataFrame, window: int) -> DataFrame:
    """``(h, u, id0, th, a, b)``: a run of the windows that start at the words ``a`` to ``a + b``, its anchor ``h`` and content ``u``."""
    schema = pa.schema([("h", pa.int64()), ("u", pa.int64()), ("id0", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            codes = [coded(x.as_py()) for x in batch.column("t")]
            off = np.concatenate(([0], np.cumsum([len(x) // 8 for x in codes])))
            data = np.frombuffer(b"".join(codes), np.uint64)
            id0, th = (batch.column(k).to_numpy() for k in KEY)
            for lo, hi in pieces(off, window):
                at = np.searchsorted(off, lo, "right") - 1
                ends = np.minimum(off[at + 1 :], hi)
                ends = ends[: np.searchsorted(ends, hi) + 1] - lo
                first, _, last, h, u = runs_of(data[lo:hi], ends, window, WORD_GRAM)
                if len(first):
                    doc = np.searchsorted(off, first + lo, "right") - 1
                    columns = (h.view(np.int64), u.view(np.int64), id0[doc], th[doc], first + lo - off[doc], (last - first).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return keys.mapInArrow(run, "h long, u long, id0 long, th long, a long, b int")


def _contents(keys: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """``kinds`` with the words of each, as hashes, from the document that it belongs to."""
    wanted = kinds.groupBy("id0", "th").agg(F.collect_list(F.struct("h", "u", "late", "many", "a", "b")).alias("r"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        names = ["h", "u", "id0", "late", "many", "words"]
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                words = coded(batch.column("t")[k].as_py())
                id0 = batch.column("id0")[k].as_py()
                for x in batch.column("r")[k].as_py():
                    rows.append((x["h"], x["u"], id0, x["late"], x["many"], words[x["a"] * 8 : (x["a"] + x["b"] + window) * 8]))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("u", pa.int64()), ("id0", pa.int64()), ("late", pa.bool_()), ("many", pa.bool_()), ("words", pa.binary())])
        for df in cut(batches):
            yield pa.RecordBatch.from_pandas(df, schema=schema, preserve_index=False)

    texts = keys.join(wanted.hint("shuffle_hash"), KEY)
    return texts.mapInArrow(run, "h long, u long, id0 long, late boolean, many boolean, words binary")


def search(texts: list[np.ndarray], owners: np.ndarray, queries: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """``(query, start, stop, least)``: the stretches of the texts numbered ``queries`` in which each window starts in a text of an earlier owner too,
    split where the earliest such owner changes."""
    index = FmIndex(texts, owners, window)
    out = []
    _, least = index.matches([texts[q] for q in queries])
    for q, first in zip(queries.tolist(), least):
        hit = np.flatnonzero(first < owners[q])
        if len(hit):
            new = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (first[hit[1:]] != first[hit[:-1]]))))
            for s, e in zip(hit[new].tolist(), hit[np.append(new[1:], len(hit)) - 1].tolist()):
                out.append((q, s, e + window, int(first[s])))
    return out


def _searched(contents: DataFrame, shards: int, window: int) -> DataFrame:
    """``(h, u, id0, start, stop)``: what of each late content is repeated from an earlier document."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, np.uint64) for x in df["words"]]
        owners = df["id0"].to_numpy()
        found = search(texts, owners, np.flatnonzero(df["late"].to_numpy()), window)
        at = [q for q, *_ in found]
        return pd.DataFrame({"h": df["h"].to_numpy()[at], "u": df["u"].to_numpy()[at], "id0": owners[at], "start": [s for _, s, _, _ in found], "stop": [e for _, _, e, _ in found]})

    own = contents.filter("not many").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return own.groupBy("shard").applyInPandas(run, "h long, u long, id0 long, start long, stop long")


def _windows(contents: DataFrame, window: int) -> DataFrame:
    """The windows of ``contents`` one by one: ``(f1, f2, h, u, id0, late, at, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("h", pa.int64()), ("u", pa.int64()), ("id0", pa.int64()), ("late", pa.bool_()), ("at", pa.int64()), ("words", pa.binary())])
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            segments = batch.column("words").to_pylist()
            data = np.frombuffer(b"".join(segments), np.uint64)
            n = np.array([len(x) // 8 for x in segments])
            k = np.repeat(np.arange(len(n)), n - window + 1)
            place = np.arange(len(k)) - np.repeat(np.cumsum(n - window + 1) - (n - window + 1), n - window + 1)
            at = (np.cumsum(n) - n)[k] + place
            hashes = [pa.array(r.of(r.sums(data), at, at + window).view(np.int64)) for r in rollers()]
            own = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[k]) for c in ("h", "u", "id0", "late")]
            words = pa.array([segments[i][p * 8 : (p + window) * 8] for i, p in zip(k.tolist(), place.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*hashes, *own, pa.array(place), words], schema=schema)

    return contents.mapInArrow(run, "f1 long, f2 long, h long, u long, id0 long, late boolean, at long, words binary")


def _searched_singly(contents: DataFrame, shards: int, window: int) -> DataFrame:
    """The same as :func:`_searched` for anchors with many contents. Equal windows are one before they are dealt to shards."""
    windows = durable(_windows(contents.filter("many"), window), "windows")
    once = windows.groupBy("f1", "f2").agg(F.min("id0").alias("id0"), F.first("words").alias("words")).withColumn("shard", F.pmod("f1", F.lit(shards)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, np.uint64) for x in df["words"]]
        _, least = FmIndex(texts, df["id0"].to_numpy(), window).matches(texts)
        return pd.DataFrame({"f1": df["f1"], "f2": df["f2"], "least": [int(x[0]) for x in least]})

    least = once.groupBy("shard").applyInPandas(run, "f1 long, f2 long, least long")
    return windows.filter("late").join(least, ["f1", "f2"]).filter("least < id0").selectExpr("h", "u", "id0", "at AS start", f"at + {window} AS stop")


def later_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Stretches ``(id0, th, start, stop)`` of words, none listed twice, covered by a window that starts in an earlier document too."""
    if window < 2 * WORD_GRAM:
        raise ValueError(f"window must be {2 * WORD_GRAM} words at least")
    keys = keyed(docs)
    every = durable(_runs(keys, window), "every")
    spread = every.groupBy("h").agg(F.min("id0").alias("lo"), F.max("id0").alias("hi")).filter("lo < hi").select("h", "lo")
    spread = durable(spread, "spread")  # so that the join is all that its stage does, and a hot anchor's rows can be split
    shared = durable(every.join(spread, "h"), "shared")
    contents = durable(shared.groupBy("h", "u").agg(F.min(F.struct(*KEY, "a", "b")).alias("r"), F.max("id0").alias("hi"), F.min("lo").alias("lo")), "contents")
    anchors = contents.groupBy("h").agg(F.count("*").alias("k"), F.max("r.id0").alias("latest"), F.min("lo").alias("first")).filter("latest > first")
    kinds = contents.join(anchors, "h").selectExpr("h", "u", "r.*", "r.id0 > lo AS late", f"k > {LARGE} AS many")
    kinds = durable(kinds, "kinds")
    sizes = {r.many: r.n for r in kinds.groupBy("many").agg(F.sum(F.expr(f"IF(many, (b + 1) * {window}, b + {window})")).alias("n")).collect()}  # two rows at most
    whole = shared.join(contents.filter("hi > r.id0").selectExpr("h", "u", "r.id0 AS m"), ["h", "u"]).filter("id0 > m").selectExpr(*KEY, "a AS start", f"a + b + {window} AS stop")
    if not sizes:
        return whole
    found = durable(_contents(keys, kinds, window), "words")
    parts = _searched(found, 1 + sizes.get(False, 0) // SHARD, window)
    if True in sizes:
        parts = parts.union(_searched_singly(found, 1 + sizes[True] // SHARD, window))
    parts = durable(parts, "parts")
    own = shared.join(parts, ["h", "u", "id0"]).selectExpr(*KEY, "a + start AS start", "a + stop AS stop")
    return whole.union(own)


def without_later(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, spans, kept``.

    Words are what stands between blanks and control characters 9 to 13. A word goes if a window of ``window`` words covers it that starts in a
    document with a smaller ``doc_id`` too; windows are those of the input. ``spans`` are the words that go, as ``start`` and ``stop`` from 0, in order; ``kept`` is the rest with
    single spaces. A null or short text loses nothing. Rows with one ``doc_id`` take nothing from one another; those without rank
    after all others. An empty table gives no rows; other columns are not read.
    """
    spans = later_repeats(docs, window).groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("r")).toDF("i", "h", "r")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id0"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))
    both = own.join(durable(spans, "spans").hint("shuffle_hash"), (F.col("id0") == F.col("i")) & (F.col("th") == F.col("h")), "left").select("doc_id", "t", "r")
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = []
            for t, r in zip(batch.column("t"), batch.column("r")):
                words = t.as_py().split()
                gone = merged(*zip(*((x["start"], x["stop"]) for x in r.as_py()))) if r.is_valid else []
                left, at = [], 0
                for s, e in gone:
                    left += words[at:s]
                    at = e
                left += words[at:]
                rows.append((len(words), len(words) - len(left), [{"start": s, "stop": e} for s, e in gone], b" ".join(left).decode()))
            kinds = (pa.int64(), pa.int64(), pa.list_(span), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string")
