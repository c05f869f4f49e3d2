"""A compressed index of a shard of texts: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

The alphabet is any sequence of integers (here hashes of words). Suffixes are ordered through their first ``depth`` letters only, which is all that
searches of patterns of up to ``depth`` letters need: an interval of suffixes that start with a pattern is the same whatever the order inside it.
:meth:`FmIndex.matches` streams queries through the index from right to left, many in lockstep, and keeps for each place the longest pattern that
starts there and occurs in the index (matching statistics, capped at ``depth``).
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with the number of ones before any place, 64 places a block."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        packed = np.packbits(np.pad(bits, (0, n * 64 - len(bits))), bitorder="little")
        self.blocks = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int32)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & below)


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of the letters, the highest first."""

    def __init__(self, letters: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.zeros = [], []
        x = letters
        for k in reversed(range(self.levels)):
            one = (x >> k & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(len(x) - one.sum()))
            x = np.concatenate((x[~one], x[one]))

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``letter`` stands before the place ``at``, plus where its letters begin on the last level."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where(letter >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at


def _ranks(text: np.ndarray, depth: int) -> list[np.ndarray]:
    """Classes of the places of ``text`` by their first 1, 2, 4 ... letters, until ``depth`` is reached. Beyond the end stands nothing."""
    ranks, have = [text.astype(np.int64)], 1
    while have < depth:
        low = ranks[-1]
        key = low * (int(low.max()) + 2)
        key[:-have] += low[have:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1])
        have *= 2
    return ranks


class FmIndex:
    """The index of ``texts``, each a sequence of integers, of which the one at ``k`` weighs ``weights[k]``.

    ``weight[i]`` is the least weight of the texts in which the first ``depth`` letters of suffix ``i`` start.
    """

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.array([len(x) for x in texts], np.int64)
        self.alphabet, letters = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]), return_inverse=True)
        text = np.zeros(len(letters) + len(texts), np.int64)  # 0 ends each text
        stop = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(text), bool)
        inside[stop] = False
        text[inside] = letters + 1
        size = len(self.alphabet) + 1
        ranks = _ranks(text, depth)
        order = np.argsort(ranks[-1], kind="stable")
        self.n = len(text)
        shared = np.zeros(max(self.n - 1, 0), np.int64)  # letters that neighbours in order share, as far as the classes tell
        for k in reversed(range(len(ranks))):
            a, b = order[:-1] + shared, order[1:] + shared
            fits = (a < self.n) & (b < self.n)
            same = fits & (ranks[k][np.where(fits, a, 0)] == ranks[k][np.where(fits, b, 0)])
            shared += np.where(same, 1 << k, 0)
        lcp = np.concatenate(([-1], np.minimum(shared, depth), [-1])).astype(np.int8 if depth < 127 else np.int32)
        self.lcp = [lcp]  # at k the least of 2**k neighbours
        while 1 << len(self.lcp) <= self.n:
            half = 1 << (len(self.lcp) - 1)
            self.lcp.append(np.minimum(self.lcp[-1][:-half], self.lcp[-1][half:]))
        self.first, self.after = self._groups(lcp, depth - 1)
        start, _ = self._groups(lcp, depth)
        own = np.repeat(np.asarray(weights, np.int64), sizes + 1)[order]
        heads = np.unique(start)
        self.weight = np.minimum.reduceat(own, heads)[np.searchsorted(heads, start)] if self.n else own
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.bwt = Wavelet(text[order - 1], size)
        self.base = self.bwt.rank(np.arange(size), np.zeros(size, np.int64))

    def _groups(self, lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes that share ``depth`` letters with each one begin and end."""
        heads = np.flatnonzero(lcp[: self.n] < depth)
        group = np.cumsum(lcp[: self.n] < depth) - 1
        return heads[group], np.append(heads[1:], self.n)[group]

    def codes(self, query: np.ndarray) -> np.ndarray:
        """The letters of ``query`` in the index, 0 for those it lacks."""
        at = np.minimum(np.searchsorted(self.alphabet, query), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == query, at + 1, 0) if len(self.alphabet) else np.zeros(len(query), np.int64)

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with ``letter`` and then a pattern, from those that start with the pattern."""
        shift = self.begin[letter] - self.base[letter]
        both = self.bwt.rank(np.concatenate((letter, letter)), np.concatenate((low, high)))
        return both[: len(low)] + shift, both[len(low) :] + shift

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider intervals, and how many letters their suffixes share: the pattern without some letters on the right."""
        depth = np.maximum(self.lcp[0][low], self.lcp[0][high]).astype(np.int64)
        left, right = low.copy(), high.copy()
        for k in reversed(range(len(self.lcp))):
            table, step = self.lcp[k], 1 << k
            at = left - step + 1
            ok = (at >= 0) & (table[np.maximum(at, 0)] >= depth)
            left = np.where(ok, at - 1, left)
            ok = (right + step <= self.n + 1) & (table[np.minimum(right, len(table) - 1)] >= depth)
            right = np.where(ok, right + step, right)
        return np.maximum(left, 0), np.minimum(right, self.n), np.maximum(depth, 0)

    def matches(self, queries: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each query and place the letters matched from there on, ``depth`` at most, and where it is ``depth`` the least weight of a
        text in which these letters start (else the largest integer)."""
        sizes = np.array([len(q) for q in queries], np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)
        codes = self.codes(np.concatenate([*queries, np.zeros(0, np.uint64)]))
        length = np.zeros(len(codes), np.int16 if self.depth < 1 << 15 else np.int64)
        least = np.full(len(codes), np.iinfo(np.int64).max)
        at = ends[order] - 1  # from the last letter of each to the first
        sorted_sizes = sizes[order]
        low, high, have = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sorted_sizes, -step, "left"))  # longer than step
            low, high, have, place = low[:live], high[:live], have[:live], at[:live] - step
            letter = codes[place]
            full = have == self.depth
            low, high, have = np.where(full, self.first[np.minimum(low, self.n - 1)], low), np.where(full, self.after[np.minimum(low, self.n - 1)], high), np.where(full, self.depth - 1, have)
            new_low, new_high = self.extend(letter, low, high)
            open_ = np.flatnonzero((new_low >= new_high) | (letter == 0))
            gone = letter[open_] == 0
            new_low[open_[gone]], new_high[open_[gone]], have[open_[gone]] = 0, self.n, -1
            open_ = open_[~gone]
            while len(open_):  # no suffix has the longer pattern: give up letters on the right
                low[open_], high[open_], have[open_] = self.shorten(low[open_], high[open_])
                a, b = self.extend(letter[open_], low[open_], high[open_])
                new_low[open_], new_high[open_] = a, b
                open_ = open_[a >= b]
            low, high, have = new_low, new_high, have + 1
            length[place] = have
            whole = have == self.depth
            least[place[whole]] = self.weight[low[whole]]
        cuts = ends[:-1]
        return np.split(length, cuts), np.split(least, cuts)
