"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``depth`` bytes: two places hold a repeated passage exactly if their suffixes fall into
one group when sorted that deep. The sort runs over most significant digits first, and a suffix alone in its group leaves at once:

1. Every suffix is filed under the least of the ``GRAM``-byte strings in its first ``depth`` bytes (a choice that equal suffixes
   share), neighbours with the same choice as one run. The digit of the first pass is that string; it settles nearly all text.
2. The digit of the second pass is all that the run's suffixes read. Runs that are equal in it repeat in full, wherever they stand. A document's own
   equal runs are told before anything is shuffled and leave as one.
3. Runs that share the string but not the whole are sorted by the ``depth`` bytes of each suffix. One run stands for all equal
   ones; a group with very many different runs is spread over the cluster suffix by suffix.

Digits wider than a word are compared by two independent 64-bit hashes of their bytes.

With ``words`` the same is done on whole words in place of bytes: a text is the sequence of its words' 64-bit hashes, white space between
them doesn't count, and depths and places are in words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable
from .simhash import word_bounds

GRAM = 128
#: The same for texts as words
WORD_GRAM = 16
STEP = 1 << 18
PLACE = np.uint64((1 << 22) - 1)
KEY = ["id0", "th"]


class Roller:
    """Hashes of any substring of a buffer, by prefix sums modulo 2**64 in one random base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.byte = rng.integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
        self.word = np.uint64(int(rng.integers(1 << 62, 1 << 63)) | 1)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, x in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, x, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        out = np.zeros(n, np.uint64)
        unit = self.byte[data] if data.dtype == np.uint8 else (data * self.word) ^ (data >> np.uint64(32))
        np.cumsum(unit * self.up[: n - 1], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.down[: len(sums)][start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return x


_ROLLERS: list[Roller] = []


def rollers() -> list[Roller]:
    """The two hash families, made once in each worker."""
    if not _ROLLERS:
        _ROLLERS.extend((Roller(20_011), Roller(90_007)))
    return _ROLLERS


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs_of(data: np.ndarray, ends: np.ndarray, depth: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of suffixes ``(first, anchor, last, h, u)`` in the documents that end at ``ends`` in ``data``.

    ``h`` hashes the ``gram`` bytes (or words) at ``anchor``, ``u`` all bytes that the suffixes ``first`` to ``last`` read, with the shape.
    """
    one, two = rollers()
    width = depth - gram + 1
    if len(data) < depth:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    ok = np.ones(len(data), bool)
    start = 0
    for end in ends.tolist():
        ok[max(start, end - depth + 1) : end] = False
        start = end
    s1 = one.sums(data)
    grams = one.of(s1, slice(0, len(s1) - gram), slice(gram, None))
    order = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), width)
    starts = np.flatnonzero(ok[: len(order)])
    if not len(starts):
        return runs_of(data[:0], ends[:0], depth, gram)
    anchor = (order[starts] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, anchor, last = starts[new], anchor[new], starts[np.append(new[1:], len(starts)) - 1]
    u = two.of(two.sums(data), first, last + depth)
    shape = ((anchor - first) * 4096 + (last - first)).astype(np.uint64)
    return first, anchor, last, grams[anchor], (u + shape) * np.uint64(0xD6E8FEB86659FD93) ^ (u >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column without nulls, end to end, and where each value starts and the last ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``STEP`` bytes: whole documents, or parts of a longer one that overlap by ``depth - 1``."""
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + STEP, "right")) - 1)
        lo, hi = int(off[at]), int(off[to])
        while hi - lo > 2 * STEP:
            yield lo, lo + STEP + depth - 1
            lo += STEP
        yield lo, hi
        at = to


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as ``(id0, th, t)``: the text's bytes under a key that a null or repeated ``doc_id`` doesn't blur."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id0"), F.xxhash64(text, F.col("doc_id").isNull()).alias("th"), text.cast("binary").alias("t"))


def coded(text: bytes) -> bytes:
    """The 64-bit hashes of a text's words, end to end."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in text.split()], np.uint64).tobytes()


def once_each(first: np.ndarray, stop: np.ndarray, doc: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(keep, copies, starts, stops, docs)``: the first of the equal runs of each document and how many there are; where there are several,
    the stretches that they cover together."""
    order = np.lexsort((first, u, h, doc))
    new = np.flatnonzero(np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (u[order][1:] != u[order][:-1]))))
    copies = np.diff(np.append(new, len(order)))
    again = np.sort(order[np.repeat(copies > 1, copies)])  # runs come by document and place
    if not len(again):
        return order[new], copies, again, again, again
    s, e, d = first[again], np.maximum.accumulate(stop[again]), doc[again]
    at = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > e[:-1]))))
    return order[new], copies, s[at], e[np.append(at[1:], len(s)) - 1], d[at]


def _runs(keys: DataFrame, depth: int, unit: type = np.uint8) -> DataFrame:
    """Runs of suffixes with their key, place and ``m``, how often the document holds such a run; and with ``m`` 0 the stretches ``a`` to ``stop`` that a
    document's own equal runs cover."""
    schema = pa.schema([("h", pa.int64()), ("u", pa.int64()), ("id0", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("b", pa.int32()), ("m", pa.int32()), ("stop", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows) if unit is np.uint8 else 256  # words are coded a few texts at a time
            yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            column = batch.column("t")
            data, off = texts_of(column if unit is np.uint8 else pa.array([coded(x.as_py()) for x in column], pa.binary()))
            data, off = data.view(unit), off // np.dtype(unit).itemsize
            id0, th = (batch.column(k).to_numpy() for k in KEY)
            for lo, hi in pieces(off, depth):
                at = np.searchsorted(off, lo, "right") - 1
                ends = np.minimum(off[at + 1 :], hi)
                ends = ends[: np.searchsorted(ends, hi) + 1] - lo
                first, anchor, last, h, u = runs_of(data[lo:hi], ends, depth, GRAM if unit is np.uint8 else WORD_GRAM)
                if len(first):
                    doc = np.searchsorted(off, first + lo, "right") - 1
                    keep, copies, starts, stops, of = once_each(first, last + depth, doc, h, u)
                    none, own = np.zeros(len(of), np.int64), doc[keep]
                    columns = (
                        np.concatenate((h[keep].view(np.int64), none)), np.concatenate((u[keep].view(np.int64), none)), id0[np.concatenate((own, of))], th[np.concatenate((own, of))],
                        np.concatenate((first[keep] - off[own], starts - off[of])) + lo, np.concatenate((last[keep] - first[keep], none)).astype(np.int32),
                        np.concatenate((copies, none)).astype(np.int32), np.concatenate((last[keep] + depth - off[own], stops - off[of])) + lo,
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    return keys.mapInArrow(run, "h long, u long, id0 long, th long, a long, b int, m int, stop long")


def _windows(segments: list[bytes], counts: np.ndarray, depth: int, unit: type = np.uint8) -> tuple[np.ndarray, ...]:
    """Both hashes of every suffix's first ``depth`` bytes, with the segment and place of each."""
    data = np.frombuffer(b"".join(segments), unit)
    begin = np.concatenate(([0], np.cumsum([len(x) // data.itemsize for x in segments])))[:-1]
    seg = np.repeat(np.arange(len(segments)), counts)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[seg] + place
    return (*(r.of(r.sums(data), at, at + depth) for r in rollers()), seg, place)


def _twice(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """Whether each pair of hashes occurs more than once."""
    order = np.lexsort((f2, f1))
    same = (f1[order][1:] == f1[order][:-1]) & (f2[order][1:] == f2[order][:-1])
    out = np.zeros(len(f1), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


def repeats(docs: DataFrame, depth: int = 400, large: int = 512, words: bool = False, made: Scratch | None = None) -> DataFrame:
    """Stretches ``(id0, th, start, stop)`` of bytes of ``docs`` covered by a string of ``depth`` bytes that starts elsewhere too.

    Overlaps count and so does the same document; matches don't cross documents. Stretches of one document may touch or
    overlap. Only ``doc_id`` and ``text`` are read. A null or short text has none; rows that repeat repeat one another.
    With ``words``, ``depth``, ``start`` and ``stop`` are in words. Tables written on the way are in ``made``; the result reads them.
    """
    made = made or Scratch()
    unit, gram = (np.uint64, WORD_GRAM) if words else (np.uint8, GRAM)
    if depth < 2 * gram:
        raise ValueError(f"depth must be {2 * gram} at least")
    keys = keyed(docs)
    every = made(_runs(keys, depth, unit), "every")
    runs = every.filter("m > 0")
    wide = np.dtype(unit).itemsize
    equal = made(runs.groupBy("h", "u").agg(F.sum("m").alias("n")), "equal")
    groups = equal.groupBy("h").agg(F.sum("n").alias("rows"), F.count("*").alias("k")).filter("rows > 1")
    shared = made(runs.join(equal.join(groups, "h").select("h", "u", "n", "k"), ["h", "u"]).select("h", "u", *KEY, "a", "b", "stop", "n", "k"), "runs")
    found = shared.filter("n > 1").select(*KEY, F.col("a").alias("start"), "stop").union(every.filter("m = 0").select(*KEY, "a", "stop"))

    kinds = shared.filter("k > 1").groupBy("h", "u").agg(F.max("n").alias("n"), F.min(F.struct(*KEY, "a", "b")).alias("r"))
    kinds = made(kinds, "kinds")

    wanted = kinds.selectExpr("h", "n = 1 AS alone", "r.*").groupBy(*KEY).agg(F.collect_list(F.struct("h", "alone", "a", "b")).alias("r"))

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for i, t, text, r in zip(pdf["id0"], pdf["th"], pdf["t"], pdf["r"]):
                text = coded(text) if words else text
                for x in r:
                    rows.append((x["h"], x["alone"], i, t, x["a"], x["b"], text[x["a"] * wide : (x["a"] + x["b"] + depth) * wide]))
                    if len(rows) == 2048:
                        yield pd.DataFrame(rows, columns=["h", "alone", *KEY, "a", "b", "seg"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["h", "alone", *KEY, "a", "b", "seg"])

    cut = keys.join(wanted.hint("shuffle_hash"), KEY).mapInPandas(segments, "h long, alone boolean, id0 long, th long, a long, b int, seg binary")
    cut = made(cut, "segments")
    many = made(kinds.groupBy("h").count().filter(F.col("count") > large).select("h"), "many")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            f1, f2, seg, place = _windows(rows["seg"].tolist(), rows["b"].to_numpy().astype(np.int64) + 1, depth, unit)
            hit = np.flatnonzero(_twice(f1, f2) & rows["alone"].to_numpy()[seg])
            seg, place = seg[hit], place[hit]
            new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (place[1:] != place[:-1] + 1)))) if len(hit) else hit
            own = rows.iloc[seg[new]]
            a = own["a"].to_numpy()
            return pd.DataFrame({"id0": own["id0"].to_numpy(), "th": own["th"].to_numpy(), "start": a + place[new], "stop": a + place[np.append(new[1:], len(hit)) - 1] + depth if len(hit) else a})

        held: list[pd.DataFrame] = []
        size = 0
        for pdf in (pdf.iloc[at : at + 512] for pdf in batches for at in range(0, len(pdf), 512)):
            held.append(pdf)
            size += int(pdf["seg"].str.len().sum())
            if size >= 2 * STEP:
                rows = pd.concat(held, ignore_index=True)
                full = (rows["h"] != rows["h"].iloc[-1]).to_numpy()  # sorted by h; the last group may go on
                if full.any():
                    yield flush(rows[full].reset_index(drop=True))
                held = [rows[~full]]
                size = int(held[0]["seg"].str.len().sum())
        if held and len(held[0]):
            yield flush(pd.concat(held, ignore_index=True))

    narrow = cut.join(many, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    found = found.union(narrow.mapInPandas(sort, "id0 long, th long, start long, stop long"))
    if many.isEmpty():
        return found

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                rows = pdf.iloc[at : at + 1024]
                f1, f2, seg, place = _windows(rows["seg"].tolist(), rows["b"].to_numpy().astype(np.int64) + 1, depth, unit)
                own = rows.iloc[seg]
                yield pd.DataFrame({"f1": f1.view(np.int64), "f2": f2.view(np.int64), "alone": own["alone"].to_numpy(), "id0": own["id0"].to_numpy(), "th": own["th"].to_numpy(), "start": own["a"].to_numpy() + place})

    windows = made(cut.join(many, "h", "left_semi").mapInPandas(spread, "f1 long, f2 long, alone boolean, id0 long, th long, start long"), "windows")
    twice = windows.groupBy("f1", "f2").count().filter("count > 1").select("f1", "f2")
    return found.union(windows.filter("alone").join(twice, ["f1", "f2"], "left_semi").selectExpr(*KEY, "start", f"start + {depth} AS stop"))


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Disjoint stretches in order, of which none touches the next."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, stops)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept(data: bytes | memoryview, gone: list[tuple[int, int]]) -> list[bytes | memoryview]:
    """What stands between the stretches ``gone``."""
    at, out = 0, []
    for s, e in gone:
        out.append(data[at:s])
        at = e
    return [*out, data[at:]]


def whole_characters(data: bytes | memoryview, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``gone`` without bytes of characters that it covers in part, so that the rest is UTF-8."""
    out = []
    for s, e in gone:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, list[int], list[int], list[int], list[int]]]:
    """The bytes of each row's ``__t`` and what its stretches are: ``__starts``, ``__stops``, and in words ``__wstarts`` and ``__wstops``."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        data, off = texts_of(part.column("__t"))
        view = memoryview(data)
        lists = zip(*(part.column(c).to_pylist() for c in ("__starts", "__stops", "__wstarts", "__wstops")))
        for i, spans in enumerate(lists):
            yield view[off[i] : off[i + 1]], *(x or [] for x in spans)


def _matched(docs: DataFrame, depth: int, *columns: str, words: int | None = None) -> DataFrame:
    """``doc_id``, the text ``__t`` and ``columns`` of each row of ``docs`` with its stretches as ``__starts`` and ``__stops``, and those of ``words`` words as ``__wstarts`` and ``__wstops``; null where it has none."""
    own_tables = Scratch()

    def of(depth: int, words: bool) -> DataFrame:
        made = Scratch()
        # rows that are equal in id and text all have the same stretches
        rows = own_tables(repeats(docs, depth, words=words, made=made).distinct().withColumn("w", F.lit(words)), "found")
        made.drop()  # one search's tables are gone before the next one starts
        return rows

    found = of(depth, False)
    if words:
        found = found.union(of(words, True))
    lists = [F.collect_list(F.when(F.col("w") == w, F.col(c))) for w in (False, True) for c in ("start", "stop")]
    spans = durable(found.groupBy(*KEY).agg(*lists).toDF("__i0", "__h0", "__starts", "__stops", "__wstarts", "__wstops"), "spans")
    own_tables.drop()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", *columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__i"), F.xxhash64(text, F.col("doc_id").isNull()).alias("__h"), text.cast("binary").alias("__t"))
    both = own.join(spans.hint("shuffle_hash"), (F.col("__i") == F.col("__i0")) & (F.col("__h") == F.col("__h0")), "left")
    return both.select("doc_id", *columns, "__t", "__starts", "__stops", "__wstarts", "__wstops")


def cut_repeats(docs: DataFrame, depth: int = 400, words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (lowercase hex of the bytes left).

    Each byte that :func:`repeats` covers goes. A null text counts as an empty one. An empty table gives none.
    With ``words`` two columns follow: ``n_passage_words``, how many words are covered by that many in a row that start elsewhere too, and
    ``n_passages``, the unbroken runs of them. They tell of passages shorter than ``depth`` bytes as well; what is removed stays as it is.
    """
    schema = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema += [("n_passages", pa.int64()), ("n_passage_words", pa.int64())] if words else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, starts, stops, wstarts, wstops in _stretches(batch):
                gone, passages = merged(starts, stops), merged(wstarts, wstops)
                sha = hashlib.sha256()
                for part in kept(data, gone):
                    sha.update(part)
                rows.append((len(data), sum(e - s for s, e in gone), len(gone), sha.hexdigest(), len(passages), sum(e - s for s, e in passages)))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(name for name, _ in schema)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", n_passages long, n_passage_words long" if words else ""
    return _matched(docs, depth, words=words).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def without_repeats(docs: DataFrame, depth: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated stretches cut from ``text`` and ``n_chars``, where there is one, counted anew.

    ``words`` adds the stretches covered by that many words in a row that stand elsewhere too, however short they are in bytes.
    A character that a stretch covers in part stays whole. No row goes; one whose whole text repeats has an empty text left.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, starts, stops, wstarts, wstops in _stretches(batch):
                if wstarts:
                    opens, ends = word_bounds(data)
                    starts, stops = starts + opens[wstarts].tolist(), stops + ends[np.array(wstops) - 1].tolist()
                texts.append(str(b"".join(kept(data, whole_characters(data, merged(starts, stops)))), "utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=["doc_id", *rest, "text"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    cut = _matched(docs, depth, *rest, words=words).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *rest)) + ", text string")
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
