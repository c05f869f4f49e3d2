"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run without white space, marked at its front as the vocabulary marks words. The distinct ones of a stretch of
documents form a trie; the best segmentation of a prefix is found once, whatever the number of pre-tokens that begin with it, level by level
for all nodes of a depth at a time. The node where a pre-token ends holds its count.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def load_pieces(path: str) -> dict[str, float]:
    """Plain pieces of a SentencePiece vocabulary with a log probability by Zipf's law of their rank; the vocabulary is used as it is.

    Such a vocabulary ranks its pieces by score; byte, control and unknown pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -float(np.log(rank + 10.0)) for rank, i in enumerate(plain)}


def _hash(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for i in range(len(points)):
        h = h * BASE + (points[i : i + 1].astype(np.uint64) + np.uint64(1)) * MIX
    return h[0]


class Unigram:
    """Counts of the best segmentation; a character outside the vocabulary falls back to its UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        self.lost = min(pieces.values(), default=0.0) - 10.0
        h = np.array([_hash(np.frombuffer(p.encode("utf-32-le"), np.uint32)) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hash, self.score = h[order], np.array(list(pieces.values()))[order]
        self.pieces = pieces

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Scores of the pieces with the hashes ``h``, or minus infinity."""
        if not len(self.hash):
            return np.full(h.shape, -np.inf)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.score[at], -np.inf)

    def counts(self, words: list[str]) -> list[int]:
        """The number of tokens of each word. On equal scores fewer tokens win."""
        marked = [MARK + w for w in words]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in marked])
        begin = np.cumsum(size) - size
        out = np.zeros(len(words), np.int64)
        node, live = np.zeros(len(words), np.int64), np.arange(len(words))
        # for each node of the level: scores and counts of the prefixes 1, 2, ... characters shorter, and hashes of its last characters
        score, count, tail = np.zeros((1, 1)), np.zeros((1, 1), np.int64), np.zeros((1, 0), np.uint64)
        for depth in range(int(size.max(initial=0))):
            key, node = np.unique(node * (1 << 21) + points[begin[live] + depth], return_inverse=True)
            parent, point = key >> 21, key & ((1 << 21) - 1)
            own = (point.astype(np.uint64) + np.uint64(1)) * MIX
            tail = np.hstack((own[:, None], (tail[parent] * BASE + own[:, None])[:, : self.longest - 1]))
            before, steps = score[parent], count[parent]
            value = before + self.lookup(tail)
            tokens = steps + 1
            width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
            fallback, known = before[:, 0] + self.lost * width, value[:, 0] > -np.inf
            value[:, 0] = np.where(known, value[:, 0], fallback)
            tokens[:, 0] = np.where(known, tokens[:, 0], steps[:, 0] + width)
            best = value.max(axis=1)
            fewest = np.where(value == best[:, None], tokens, np.iinfo(np.int64).max).min(axis=1)
            score = np.hstack((best[:, None], before[:, : self.longest - 1]))
            count = np.hstack((fewest[:, None], steps[:, : self.longest - 1]))
            ends = size[live] == depth + 1
            out[live[ends]] = fewest[node[ends]]
            live, node = live[~ends], node[~ends]
        return out.tolist()


    def count_long(self, data: bytes, step: int = 65_536) -> int:
        """The number of tokens of one long word in UTF-8, as in :meth:`counts`, kept apart from the trie.

        It is read ``step`` bytes at a time; of what lies behind only the last scores and characters of a piece's length are held.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        longest, pieces = self.longest, self.pieces
        behind, score, count = "", [0.0], [0]
        for at in range(0, len(data), step):
            new = decoder.decode(data[at : at + step], at + step >= len(data))
            text = behind + (MARK + new if at == 0 else new)
            for end in range(len(behind) + 1, len(text) + 1):
                best, fewest = -np.inf, 0
                base = len(score) - 1
                for size in range(1, min(longest, len(score), end) + 1):
                    own = pieces.get(text[end - size : end])
                    width = 1
                    if own is None:
                        if size > 1:
                            continue
                        width = len(text[end - 1].encode("utf-8", "surrogatepass"))
                        own = self.lost * width
                    value, n = score[base - size + 1] + own, count[base - size + 1] + width
                    if value > best or (value == best and n < fewest):
                        best, fewest = value, n
                score.append(best)
                count.append(fewest)
                if len(score) > 4096:
                    del score[:-longest], count[:-longest]
            behind = text[-longest:]
        return count[-1]


def count_tokens(docs: DataFrame, model_path: str = MODEL, longest: int = 64, remembered: int = 300_000) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for each row of ``docs``, over its whole text.

    Pre-tokens are runs without white space (space, 09-0D), never cut. Those of over ``longest`` bytes are scored one by one and not
    remembered. A null or empty text has no tokens. ``remembered`` bounds the pre-tokens whose counts a task keeps; beyond it they are counted anew. The
    vocabulary is read by the driver and sent along: its size is that of the file. Nothing is shuffled. An empty table gives none.
    """
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = Unigram(pieces.value), {}

        def count(texts: list[list[bytes]]) -> list[int]:
            nonlocal known
            new = [w for w in set().union(*texts).difference(known) if len(w) <= longest]
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                known.update(zip(some, model.counts([w.decode("utf-8", "replace") for w in some])))
            out = [sum(known[w] if len(w) <= longest else model.count_long(w) for w in words) for words in texts]
            if len(known) > remembered:
                known = {}
            return out

        for pdf in batches:
            held, size, pre, total = [], 0, [], []
            for t in pdf["t"]:
                held.append((t or b"").split())
                size += len(held[-1])
                if size > 50_000:
                    total += count(held)
                    pre += map(len, held)
                    held, size = [], 0
            total += count(held)
            pre += map(len, held)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_pretokens": pre, "n_tokens": total})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInPandas(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
