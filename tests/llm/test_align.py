"""Token alignment against sets of end offsets, whole texts encoded at once."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerloom.llm import align

from .test_llm import documents, words

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def models():
    with open(A, "rb") as a, open(B, "rb") as b:
        return align.ByteLevel(a.read()), align.Pieces(b.read())


def ends(ids, table):
    at, out = 0, []
    for i in ids:
        at += len(table[i])
        out.append(at)
    return out


class Whole:
    """The library that the file is made for."""

    def __init__(self):
        self.bytes = models()[0].bytes
        self.model = Tokenizer.from_file(A)
        self.model.encode_special_tokens = True

    def encode(self, texts):
        return [x.ids for x in self.model.encode_batch(texts, add_special_tokens=False)]


def brute(texts):
    """Counts and digests from the offsets where tokens end, whole texts encoded at once, without stretches, states or memory."""
    a, b = Whole(), models()[1]
    rows, links = [], []
    for text in texts:
        ia, ib = (side.encode([" " + (text or "")])[0] for side in (a, b))
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(side.bytes[i] for i in ids) != whole for side, ids in ((a, ia), (b, ib))):
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = ends(ia, a.bytes), ends(ib, b.bytes)
        both = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if low < e <= end) for ids, es in ((ia, ea), (ib, eb))))
            low = end
        links.append([(x, y) for x, e in zip(ia, ea) for y in [ib[eb.index(e)] if e in eb else None] if y is not None] if len(ia) < 400 else [(ia[ea.index(e)], ib[eb.index(e)]) for e in both])
        rows.append((len(ia), len(ib), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return {i: (*r[:3], len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), r[3]) for i, (r, own) in enumerate(zip(rows, links))}


def mixed():
    rng = random.Random(41)
    odd = ["  two  spaces ", "tab\tand\n\nlines \n x", "\u00a0hard\u3000wide \u2028x", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'VE", "\u2581 \u2581\u2581a", "\ufb01 \u212b \uff21 e\u0301", "日本語のテキスト 한국어", "\U0001f600\U0001f1e9\U0001f1ea \u200d", "\x00 \x1c \x1f a\x1f b", " ", "\n", "a", "", None, "x ", " x", "a  b", "a\n b", "1234567 12.50 €", "x" * 300]
    return odd + odd[:4] + ["".join(rng.choices("ab \n\t\u00a0é\u2581'.19日", k=rng.randint(1, 60))) for _ in range(150)] + [words(rng, 80) for _ in range(5)]


@pytest.mark.parametrize("limit", [0, 40, 1 << 20])
def test_by_offsets(spark, limit):
    texts = mixed()
    df = documents(spark, texts).withColumns({c: F.lit(1) for c in ("row", "pair", "links", "count", "n")})
    got = {r.doc_id: tuple(r)[1:] for r in align.align(df, A, B, limit).collect()}
    assert got == brute(texts)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").coalesce(2)
    rows = df.collect()
    want = brute([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in align.align(df, A, B).collect()}
    assert got == {r.doc_id: want[i] for i, r in enumerate(rows)}


def test_parts_and_memory(monkeypatch):
    rng = random.Random(42)
    text = words(rng, 3000) + "  \n " + "y" * 5000 + " end"
    whole = align.Aligner(*models())
    assert whole.cut and whole.a.fast
    want = whole.align(text)
    monkeypatch.setattr(align, "AT_ONCE", 97)
    monkeypatch.setattr(align, "REMEMBERED", 20)
    for cut in (True, False):
        small = align.Aligner(*models())
        small.cut = cut
        got = small.align(text)
        assert got[:4] == want[:4] and got[4].tolist() == want[4].tolist() and got[5].tolist() == want[5].tolist()
        assert len(small.known) < 60 and len(small.before) < 60


def test_states_are_suffixes():
    t = align.Transducer([b" ab", b"c", b"cd", b"x"], [b" ", b"abc", b"d", b"b"])
    assert t.groups([0, 2], [0, 1, 2]) == [(2, 3)]
    assert t.groups([0, 3], [0, 1]) is None and t.groups([0], [0]) is None and t.groups([], []) == []
    assert all(any(token.endswith(rest) for side in t.bytes for token in side) for _, rest in t.names)


def test_no_rows(spark):
    assert align.align(documents(spark, ["x"]).filter("doc_id < 0"), A, B).count() == 0
