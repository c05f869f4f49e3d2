"""Alignment of two tokenizers' tokens of one text, byte for byte, by a dangling-suffix transducer.

Tokens of both sides are bytes. The transducer's state is the side that leads and its bytes that the other side hasn't matched yet, the dangling
suffix. The side that lags gives the next token; a transition depends on the state and that token alone and is memoised. Where nothing dangles both
sides end together: a group closes. A state is a suffix of some token, so the table is bounded by the vocabularies.

Where both tokenizers are known to cut at a place whatever stands around it (:func:`separable`), a text is split there first, and what the
transducer says of a stretch is kept, up to a bounded number of stretches: words that repeat are encoded once a worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Stretches that a worker remembers of late and, once more, of before, and the longest one in characters
REMEMBERED, LONGEST = 250_000, 48
#: Characters given to the tokenizers at a time
AT_ONCE = 1 << 18
#: Id pairs whose counts are broadcast at most: 24 bytes each
BROADCAST = 1 << 20
#: Before a space after a character other than white space; a lone space at the end stays with what it follows
CUT = re.compile(r"(?<=\S)(?= .)", re.S)
#: Where a text, after the space put before it, isn't words with one space between them
UNEVEN = re.compile(r"\s | $")


class Transducer:
    """Groups of tokens that end together, from the token ids of both sides and the bytes of each id."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (b_bytes, a_bytes)  # by "does A lead": who leads waits for the other
        self.states: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        self.names = [(False, b"")]
        self.moves: list[dict[int, int]] = [{}]

    def _move(self, state: int, token: int) -> int:
        """The next state, -1 where the sides differ."""
        leads, rest = self.names[state]
        new = self.bytes[0 if leads else 1][token]
        if new.startswith(rest):
            leads, rest = not leads, new[len(rest) :]
        elif rest.startswith(new):
            rest = rest[len(new) :]
        else:
            return self.moves[state].setdefault(token, -1)
        name = (leads and bool(rest), rest)
        if name not in self.states:
            self.states[name] = len(self.names)
            self.names.append(name)
            self.moves.append({})
        return self.moves[state].setdefault(token, self.states[name])

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of ``a`` and of ``b`` lie before the end of each group; None if the sides don't spell the same."""
        out: list[tuple[int, int]] = []
        i = j = state = 0
        moves, names, n, m = self.moves, self.names, len(a), len(b)
        while True:
            if names[state][0]:
                if j == m:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n:
                    break
                token = a[i]
                i += 1
            to = moves[state].get(token)
            state = self._move(state, token) if to is None else to
            if state < 0:
                return None
            if state == 0:
                out.append((i, j))
        return out if state == 0 and j == m else None


#: How byte-level BPE cuts a text into words where its file says nothing else
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level BPE from a file of the ``tokenizers`` library. Strings of special tokens are plain text.

    Where the file holds nothing but merges in the order of their ids, ``tiktoken`` gives the same ids several times faster.
    """

    def __init__(self, file: bytes):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        spelt = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        told = json.loads(file)
        vocab, special = told["model"]["vocab"], {x["content"]: x["id"] for x in told.get("added_tokens") or ()}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(spelt[c] for c in token)
        merges = [x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        cut = told["pre_tokenizer"] or {}
        self.fast = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not told["normalizer"] and ids == list(range(256, 256 + len(ids)))
        if self.fast:
            import tiktoken

            ranks = {self.bytes[i]: i for token, i in vocab.items() if token not in special}
            self.model = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(file.decode())
            self.model.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.model.encode_ordinary(x) for x in texts]
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A model of the ``sentencepiece`` library, which puts a space before each text itself; so the one that texts here start with is left out."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("\u2581", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode(x[1:]) for x in texts]  # a list would start threads for each call


def separable(a: ByteLevel, b: Pieces) -> bool:
    """Whether both sides cut before each space that follows a character other than white space, whatever stands around it.

    So it is if no token of either has such a space inside, and the texts aren't changed (blanks joined or trimmed) before they are cut.
    """
    inside = any(re.search(r"\S ", x.decode("utf-8", "replace")) for side in (a, b) for x in side.bytes)
    probe = ["  x  y \n z  ", " \t\u00a0x", " x"]
    return not inside and all(b"".join(side.bytes[i] for i in ids) == text.encode() for side in (a, b) for text, ids in zip(probe, side.encode(probe)))


class Aligner:
    """Groups and links of texts. What was said of a stretch of text is remembered, for a bounded number of short stretches.

    A stretch goes by its text without the space that it starts with.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.transducer = Transducer(a.bytes, b.bytes)
        self.cut = separable(a, b)
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def learn(self, stretches: list[str]) -> None:
        wide, known, a_bytes, b_bytes = len(self.b.bytes), self.known, self.a.bytes, self.b.bytes
        whole = [" " + x for x in stretches]
        for key, text, a, b in zip(stretches, whole, self.a.encode(whole), self.b.encode(whole)):
            data = text.encode()
            spelt = b"".join([a_bytes[i] for i in a]) == data == b"".join([b_bytes[i] for i in b])
            ends = self.transducer.groups(a, b) if spelt else None
            if ends is None:
                known[key] = None
                continue
            groups, links, i, j = [], [], 0, 0
            for k, m in ends:
                x, y = a[i:k], b[j:m]
                groups.append(f"{x[0]}|{y[0]}" if k - i == m - j == 1 else ",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                links.append(x[-1] * wide + y[-1])
                i, j = k, m
            known[key] = (len(a), len(b), len(ends), ";".join(groups), array("q", links).tobytes())  # nothing that the garbage collector has to follow

    def parts(self, text: str) -> Iterator[str]:
        """``text`` in parts of about ``AT_ONCE`` characters that end where both sides cut."""
        at = 0
        while self.cut and len(text) - at > AT_ONCE and (found := CUT.search(text, at + AT_ONCE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def found(self, text: str) -> list[tuple | None]:
        """What is known of each stretch of ``text``, which starts with a space."""
        if not self.cut:
            stretches = [text[1:]]
        elif UNEVEN.search(text):
            stretches = [x[1:] for x in CUT.split(text)]
        else:
            stretches = text[1:].split(" ")
        known, before = self.known, self.before
        new = []
        for x in set(stretches):
            if x not in known:
                if x in before:
                    known[x] = before[x]
                else:
                    new.append(x)
        self.learn(new)
        out = [known[x] for x in stretches]
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        if len(known) > REMEMBERED:
            self.known, self.before = {}, known
        return out

    def align(self, text: str | None) -> tuple:
        """``(tokens of a, of b, groups, digest, pairs, counts)`` of a space and ``text``; its links are ``counts`` of each of the distinct ``pairs``."""
        totals, sha, pairs = np.zeros(3, np.int64), sha256(), []
        for k, part in enumerate(self.parts(" " + text) if text else ()):
            found = self.found(part)
            if None in found:
                pairs = []
                break
            a, b, groups, spelt, links = zip(*found)
            totals += (sum(a), sum(b), sum(groups))
            sha.update((";" if k else "").encode() + ";".join(spelt).encode())
            pairs.append(np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True))
        if not pairs:
            return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(pairs) == 1:
            return (*totals.tolist(), sha.hexdigest(), *pairs[0])
        each, place = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
        return (*totals.tolist(), sha.hexdigest(), each, np.bincount(place, np.concatenate([n for _, n in pairs])).astype(np.int64))


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(name: str, a: bytes, b: bytes) -> Aligner:
    """One aligner a worker for each pair of models."""
    if name not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(ByteLevel(a), Pieces(b))
    return _ALIGNERS[name]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, links)`` for each row; ``links`` counts each pair ``a * size of b + b`` once a row.

    The two files are read on the driver and sent along, a few megabytes. A text that is null, empty or not spelt byte by byte by both sides has
    no tokens: zeros, an empty digest and no links.
    """
    with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
        files = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))
    name = f"{a_path}|{b_path}"
    link = pa.struct([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _aligner(name, *files.value)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = [model.align(text.as_py()) for text in batch.column("text")]
            columns = list(zip(*rows))
            off = np.concatenate(([0], np.cumsum([len(x) for x in columns[4]]))).astype(np.int32)
            links = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in columns[4:]], fields=list(link))
            numbers = [pa.array(x, pa.int64()) for x in columns[:3]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(columns[3], pa.string()), pa.ListArray.from_arrays(off, links)], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair: long, n: long>>")


def pair_counts(links: DataFrame, wide: int) -> DataFrame:
    """``(pair, count, best)``: how many links hold a pair, and whether no pair with the same b has more."""
    counts = durable(links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % wide), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return durable(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def looked_up(links: DataFrame, pairs: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """``links`` with the ``count`` and ``best`` of their pairs: the most frequent pairs, ``limit`` at most, are broadcast, the rest joined by a shuffle.

    Pairs beyond ``limit`` are rarer than all that are broadcast, so no key of the shuffle is hot.
    """
    power = F.floor(F.log2(F.col("count").cast("double"))).cast("int").alias("power")
    sizes = {r.power: r.n for r in pairs.groupBy(power).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        if total + sizes[p] > limit:
            break
        least, total = p, total + sizes[p]
    head = F.col("count") >= F.lit(float(2**least))
    common = links.join(F.broadcast(pairs.filter(head)), "pair")
    if total == sum(sizes.values()):
        return common
    keys = F.broadcast(pairs.filter(head).select("pair"))
    return common.unionByName(links.join(keys, "pair", "left_anti").join(pairs.filter(~head).hint("merge"), "pair"))


def align(docs: DataFrame, a_path: str, b_path: str, limit: int = BROADCAST) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Encodes a space and the text by the byte-level BPE of ``a_path`` and the text by the pieces of ``b_path``, without special tokens. Groups end
    where tokens of both end; each end links the two tokens that end there, so there are as many links as groups. ``count_sum`` adds up, over
    links, how many links of all documents hold the same two ids; ``n_best`` are the links whose pair has the most for its id of ``b``, ties included.
    Rows that repeat count as often as they stand there. Null, empty and unspellable texts have zeros. An empty table gives no rows. Texts of any length are
    taken in parts.
    """
    import sentencepiece

    wide = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    table = durable(aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = table.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.n")
    found = looked_up(links, pair_counts(links, wide), limit)
    sums = found.groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = table.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left").na.fill(0, ["n_links", "n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
