"""Benchmark decontamination by templates: a question with other numbers, names or units is still that question.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after a number turn into typed places. Every
window of ``window`` template words of every document is looked up in a hash table of the benchmark's windows. Hits that lie on
neighbouring diagonals of a document and an item are put together, and the values that fill the places on both sides are held against each
other: one item value must always have become the same document value.

The table is broadcast, so the benchmark is taken in parts of bounded size, each held against all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?\n]|[%$€£°]")
#: Words that are a unit after a number
UNITS = frozenset("% ° $ € £ mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t oz lb lbs pound pounds ton tons ml l liter liters litre litres ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros degree degrees kb mb gb tb hz khz mhz ghz v w kw kwh mph kph kmh".split())
#: Words that are a number
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
WORD, CAPITAL, NUMBER, UNIT, STOP = range(5)
KIND = np.uint64(7)
PLACES = np.array([0, 0x5DEECE66D1CE4E5B, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47], np.uint64)  # no word; name, number, unit
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22


class Codes(dict):
    """A 64-bit code for each token: a hash of its lower case, with its kind in the last bits. Cleared when it grows large.

    With ``known``, lower-case tokens, all others of a kind share a code: nothing is equal to them.
    """

    def __init__(self, known: frozenset[str] | None = None):
        self.known = known

    def __missing__(self, token: str) -> int:
        import xxhash

        low = token.lower()
        if token in ".!?\n":
            kind = STOP
        elif token[0].isdigit() or low in NUMBERS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if token[0] != low[0] else WORD
        if self.known is not None and low not in self.known:
            self[token] = kind
            return kind
        self[token] = code = (xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 7) & ~7) | kind
        return code


def template(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Template words ``(words, literal, opens, start, end)``: the words, whether each is a literal, whether it may be a name as well
    (a capitalised one where a sentence starts), and the ``codes`` it stands for. ``first`` marks texts' first tokens.

    Names in a row are one place, and so are numbers.
    """
    kind = codes & KIND
    stop = kind == STOP
    starts = first | np.concatenate(([False], stop[:-1]))
    number_before = np.concatenate(([False], kind[:-1] == NUMBER)) & ~first
    place = np.zeros(len(codes), np.int64)
    place[(kind == CAPITAL) & ~starts] = 1
    place[kind == NUMBER] = 2
    place[(kind == UNIT) & number_before] = 3
    word = np.where(place > 0, PLACES[place], codes | KIND)
    goes_on = np.concatenate(([False], (place[1:] == place[:-1]) & ((place[1:] == 1) | (place[1:] == 2)) & ~first[1:])) if len(codes) else stop
    keep = np.flatnonzero(~stop & ~goes_on)
    new = np.append(np.flatnonzero(~goes_on), len(codes))
    return word[keep], place[keep] == 0, ((kind == CAPITAL) & starts)[keep], keep, new[np.searchsorted(new, keep, "right")] if len(keep) else keep


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, to be mixed: it is linear in the words."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        h = h * BASE + words[j : j + n]
    return h


def all_of(ok: np.ndarray, size: int) -> np.ndarray:
    """Whether all of each ``size`` values in a row hold."""
    total = np.concatenate(([0], np.cumsum(ok)))
    return total[size:] - total[:-size] == size


class Words:
    """Which words may occur: a table of bits, so that a word of the set is never denied."""

    def __init__(self, words: np.ndarray):
        self.bits = np.zeros(1 << TABLE_BITS, bool)
        self.bits[mixed(words) >> np.uint64(64 - TABLE_BITS)] = True

    def may(self, words: np.ndarray) -> np.ndarray:
        return self.bits[mixed(words) >> np.uint64(64 - TABLE_BITS)]


def forms(words: np.ndarray, literal: np.ndarray, opens: np.ndarray, size: int, least: int, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(place, hash)`` of each window, with the words that may be names taken as literals and as names, by turns; ``least`` literals stay.

    ``ok`` marks the words that a window may hold; windows with another are passed over.
    """
    h = windows(words, size)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), h
    total = np.concatenate(([0], np.cumsum(literal)))
    enough = total[size:] - total[:-size]
    mask = np.zeros(n, np.int64)
    first = np.flatnonzero(opens)
    for j in range(size):
        mask[(at := first - j)[(at >= 0) & (at < n)]] |= 1 << j
    some = np.flatnonzero(enough >= least if ok is None else (enough >= least) & all_of(ok, size))
    places, hashes = [some], [h[some]]
    both = some[(mask[some] > 0) & (enough[some] > least)]
    order = both[np.argsort(mask[both], kind="stable")]
    for at in np.split(order, np.flatnonzero(np.diff(mask[order])) + 1) if len(order) else []:
        whole = int(mask[at[0]])
        sub = whole
        while sub:
            own = at[enough[at] - sub.bit_count() >= least]
            if len(own):
                x = h[own]
                for j in (j for j in range(size) if sub >> j & 1):
                    x = x + (PLACES[1] - words[own + j]) * np.uint64(pow(int(BASE), size - 1 - j, 1 << 64))
                places.append(own)
                hashes.append(x)
            sub = (sub - 1) & whole
    return np.concatenate(places), mixed(np.concatenate(hashes))


class Index:
    """The windows of one part of the benchmark, by hash: those of templates (True) and those of the items' own tokens (False)."""

    def __init__(self, items: pd.DataFrame, window: int, least: int):
        codes, self.items, self.size, self.slots, self.spans, self.words = Codes(), [], [], [], [], []
        by_size: dict[tuple[bool, int], list] = {}
        for item, text in zip(items["item_id"].tolist(), items["text"].tolist()):
            tokens = TOKEN.findall(text or "")
            code = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
            own = np.flatnonzero((code & KIND) != STOP)
            if not len(own):
                continue
            size = min(window, len(own))
            h = mixed(windows(code[own] | KIND, size))
            by_size.setdefault((False, size), []).append((h, np.full(len(h), len(self.items)), np.arange(len(h))))
            words, literal, opens, start, end = template(code, np.arange(len(code)) == 0)
            size = min(window, len(words))
            at, h = forms(words, literal, opens, size, least)
            by_size.setdefault((True, size), []).append((h, np.full(len(h), len(self.items)), at))
            number = np.searchsorted(own, start)
            self.items.append(item)
            self.size.append(len(own))
            self.spans.append((number, number + end - start))
            self.words.append((words, opens | (words == PLACES[1])))
            self.slots.append([" ".join(tokens[x:y]).lower() if p else None for x, y, p in zip(start, end, ~literal | opens)])
        self.known = frozenset(token.lower() for token in codes)
        own = [x | int(KIND) for x in codes.values()]
        self.vocabulary = Words(np.array(own or [0], np.uint64))
        self.by_size = {}
        for key, found in by_size.items():
            h, item, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[h >> np.uint64(64 - TABLE_BITS)] = True
            self.by_size[key] = (h[order], item[order], at[order], np.packbits(table))


def search(index: Index, texts: list[str | None], least: int, enough: int, codes: Codes) -> list[tuple]:
    """``(number of the text, item, words of the item, words matched, kind)`` for each leak in ``texts``."""
    found = [TOKEN.findall(t) if t else [] for t in texts]
    length = np.array([len(x) for x in found])
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(found)), np.uint64, int(length.sum()))
    if len(codes) > 200_000:
        codes.clear()
    text = np.repeat(np.arange(len(texts)), length)
    begin = np.cumsum(length) - length
    stop = (code & KIND) == STOP
    own = np.flatnonzero(~stop)
    number = np.cumsum(~stop) - 1
    words, literal, opens, start, end = template(code, np.concatenate(([True], text[1:] != text[:-1]))[: len(code)])
    name = opens | (words == PLACES[1])
    tokens = code[own] | KIND
    # only windows of words that the benchmark has can match; a place, or a word that may be a name, always can
    ok_words, ok_tokens = index.vocabulary.may(words) | ~literal | opens, index.vocabulary.may(tokens)
    hits: dict[tuple[int, int], list[tuple]] = {}
    for (by_template, size), (h, item, at, table) in index.by_size.items():
        of = text[start] if by_template else text[own]
        if by_template:
            pos, x = forms(words, literal, opens, size, least, ok_words)
        elif len(tokens) < size:
            continue
        else:
            pos = np.flatnonzero(all_of(ok_tokens, size))
            x = mixed(windows(tokens, size)[pos])
        cell = x >> np.uint64(64 - TABLE_BITS)
        maybe = np.flatnonzero((table[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1)
        pos, x = pos[maybe], x[maybe]
        inside = of[pos] == of[pos + size - 1]
        pos, x = pos[inside], x[inside]
        low, high = np.searchsorted(h, x, "left"), np.searchsorted(h, x, "right")
        n = high - low
        pos = np.repeat(pos, n)
        entry = np.repeat(low, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        for k, m, p, q in zip(of[pos].tolist(), item[entry].tolist(), pos.tolist(), at[entry].tolist()):
            hits.setdefault((k, m), []).append((by_template, size, p, q))

    def fits(m: int, y: int, p: int) -> bool:
        own_words, own_names = index.words[m]
        return bool(own_words[y] == words[p] or (own_names[y] and name[p]))

    out = []
    for (k, m), own_hits in hits.items():
        begins, ends = index.spans[m]
        need = min(enough, index.size[m])
        placed = sorted({(int(number[start[p]] - begins[q]) if t else p - q, q, p, t, size) for t, size, p, q in own_hits})
        best = None
        for group in _neighbours(placed):
            covered: set[int] = set()
            slots: dict[int, tuple[str, str]] = {}
            reached: dict[int, set[int]] = {}
            for _, q, p, t, size in group:
                if not t:
                    covered.update(range(q, q + size))
                    continue
                done = reached.setdefault(p - q, set())
                done.update(range(q, q + size))
                for y, step in ((q - 1, -1), (q + size, 1)):  # words beyond the window that match as well
                    while 0 <= y < len(begins) and y not in done and 0 <= p - q + y < len(words) and text[start[p - q + y]] == k and fits(m, y, p - q + y):
                        done.add(y)
                        y += step
            for shift, done in reached.items():
                for y in sorted(done):
                    was = index.slots[m][y]
                    covered.update(range(int(begins[y]), int(ends[y])))
                    if was is not None and int(begins[y]) not in slots:
                        tokens = found[k][int(start[shift + y] - begin[k]) : int(end[shift + y] - begin[k])]
                        slots[int(begins[y])] = (was, " ".join(tokens).lower())
            if len(covered) < need:
                continue
            odd = strays(slots)
            matched = len(covered) - odd
            if matched >= need or 4 * odd <= len(slots):
                x = (matched, "verbatim" if all(was == now for was, now in slots.values()) else "changed")
                best = x if best is None else max(best, x)
        if best:
            out.append((k, index.items[m], index.size[m], *best))
    return out


def strays(slots: dict[int, tuple[str, str]]) -> int:
    """How many places break the exchange of values: each of the item's values stands for one value, and each value for one of the item's.

    Pairs are taken by how many places hold them, the most frequent first, as long as neither side is taken.
    """
    counts = Counter(slots.values())
    was, now, kept = set(), set(), 0
    for (a, b), n in sorted(counts.items(), key=lambda x: (-x[1], x[0][0] != x[0][1], x[0])):
        if a not in was and b not in now:
            was.add(a)
            now.add(b)
            kept += n
    return len(slots) - kept


def _neighbours(placed: list[tuple], reach: int = 4) -> Iterator[list[tuple]]:
    """Hits, sorted by diagonal, in groups of diagonals of which each is within ``reach`` of the next."""
    at = 0
    for i in range(1, len(placed) + 1):
        if i == len(placed) or placed[i][0] - placed[i - 1][0] > reach:
            yield placed[at:i]
            at = i


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 5, enough: int = 13, part_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id, n_item, n_matched, kind`` for each document and item of which it holds a passage.

    A passage is ``enough`` words of the item, or all of a shorter one, on neighbouring diagonals. It is found by windows of ``window`` template
    words (or the whole shorter item) that match with at least ``least`` literal words each, and goes on as far as the words beyond match.
    A capitalised word where a sentence starts is taken as a word and as a name; names in a row are one place, and so are numbers.
    The item's own tokens, ``window`` in a row or all of a shorter item, match too, whatever they are: so copies of items of numbers or names are found. ``kind`` is ``verbatim`` if the places hold the
    item's own values (in any case of letters) and ``changed`` otherwise. Values must be exchanged one for one: places that
    break this (:func:`strays`) don't count as matched; with fewer than ``enough`` words besides, three quarters of the places must keep to it, since small numbers also agree by chance. Null and empty texts match nothing; rows that repeat each count, a ``doc_id`` that is
    null stays null; an empty table on either side gives none. The longest match of a document and an item is reported, on ties the verbatim one.
    """
    spark = docs.sparkSession
    items = durable(benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct(), "benchmark")
    n, chars = items.agg(F.count("*"), F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()
    parts = max(1, math.ceil((chars or 0) / part_chars))
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_item long, n_matched long, kind string"
    out = spark.createDataFrame([], types)
    for part in range(parts if n else 0):
        held = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toPandas()  # about part_chars characters
        index = spark.sparkContext.broadcast(Index(held, window, least))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            codes = Codes(index.value.known)
            for pdf in batches:
                texts, ids = pdf["text"].tolist(), pdf["doc_id"]
                for at in _cuts([len(t or "") for t in texts], 1_000_000):
                    rows = search(index.value, texts[at], least, enough, codes)
                    if rows:
                        k = [r[0] for r in rows]
                        yield pd.DataFrame([r[1:] for r in rows], columns=["item_id", "n_item", "n_matched", "kind"]).assign(doc_id=ids.iloc[at].iloc[k].to_numpy())[["doc_id", "item_id", "n_item", "n_matched", "kind"]]

        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, types)
        out = found if parts == 1 else out.union(found)
    return out


def _cuts(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes add up to about ``most``."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of ``benchmark``; columns stay.

    The text alone decides, so a row whose ``doc_id`` is null or stands in another row too goes or stays by its own text. Null and empty texts stay. An
    empty table on either side leaves ``docs`` as it is.
    """
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = durable(leaks(texts, benchmark).select(F.col("doc_id").alias("__th")).distinct(), "leaks")
    return docs.join(found, F.xxhash64(docs["text"]) == found["__th"], "left_anti").select(*docs.columns)
