"""Small cases of each operator against a brute-force version, with nulls, repeats and empty tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from offerloom.llm import chat, decontam, embed_dedup, licenses, mixing, quality, queries, simhash, suffix_dedup, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(n))


def brute_cut(texts, depth=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - depth + 1):
            seen.setdefault(b[i : i + depth], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + depth] = b"\1" * depth
    out = {}
    for d, b in enumerate(data):
        left = bytes(x for x, g in zip(b, gone[d]) if not g)
        out[d] = (len(b), sum(gone[d]), len(re.findall(b"\1+", bytes(gone[d]))), hashlib.sha256(left).hexdigest())
    return out


def five_words(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_left(texts, depth=400, run=51):
    """What is left of each text without strings of ``depth`` bytes, and runs of ``run`` words, that stand twice; whole characters only."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - depth + 1):
            seen.setdefault(b[i : i + depth], []).append((d, i, i + depth))
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        for i in range(len(words) - run + 1):
            seen.setdefault(tuple(b[s:e] for s, e in words[i : i + run]), []).append((d, words[i][0], words[i + run - 1][1]))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, s, e in places:
                gone[d][s:e] = b"\1" * (e - s)
    out = []
    for b, g in zip(data, gone):
        left, at = b"", 0
        for m in re.finditer(b"\1+", bytes(g)):
            s, e = m.span()
            while s < e and b[s] & 0xC0 == 0x80:
                s += 1
            while s < e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            if s < e:
                left, at = left + b[at:s], e
        out.append((left + b[at:]).decode())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(3)
    base, other = words(rng, 300), words(rng, 150)
    texts = [base, base, other + base[100:700] + words(rng, 20), None, "", "ab" * 700, words(rng, 200), other[:450] + "x" + other[:450], base[:399], "é" + base[:405], "q" * 400, "q" * 399]
    texts += [words(rng, 5) + base[50:500] + words(rng, 8) for _ in range(8)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(documents(spark, texts)).collect()}
    assert got == brute_cut(texts)
    assert suffix_dedup.cut_repeats(documents(spark, texts).limit(0)).count() == 0


def brute_passages(texts, run=51):
    """Runs of words covered by ``run`` words in a row that start elsewhere too, and their words."""
    data = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = {}
    for d, w in enumerate(data):
        for i in range(len(w) - run + 1):
            seen.setdefault(tuple(w[i : i + run]), []).append((d, i))
    hit = [bytearray(len(w)) for w in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d][i : i + run] = b"\1" * run
    return {d: (len(re.findall(b"\1+", bytes(h))), sum(h)) for d, h in enumerate(hit)}


def test_suffix_dedup_tells_of_passages_under_400_bytes(spark, tmp_path):
    rng = random.Random(31)
    p = words(rng, 55).split()
    assert len(" ".join(p).encode()) < 400
    texts = [words(rng, 40) + " " + " ".join(p) + " " + words(rng, 30), words(rng, 9) + "\n" + "\t".join(p), words(rng, 20) + " " + " ".join(p[:50]) + " x", None, "", words(rng, 90)]
    texts += [" ".join(p[2:53]), words(rng, 60) + " " + texts[5], "a b " * 40]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == brute_cut(texts)  # the cut itself is still that of 400 bytes
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in rows}
    assert got == brute_passages(texts)
    assert [got[i] for i in (0, 1, 2, 3, 4, 6, 8)] == [(1, 55), (1, 55), (0, 0), (0, 0), (0, 0), (1, 51), (1, 80)]


def test_suffix_dedup_large_groups(spark):
    rng = random.Random(8)
    base = words(rng, 120)
    texts = [words(rng, 3) + base[rng.randint(0, 60) :] + words(rng, 3) for _ in range(12)]
    keys = suffix_dedup.repeats(documents(spark, texts), 400, large=2)
    few = suffix_dedup.repeats(documents(spark, texts), 400)

    def covered(df):
        return {(r.id0, x) for r in df.collect() for x in range(r.start, r.stop)}

    assert covered(keys) == covered(few) != set()


def fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(n, linked):
    low = list(range(n))
    for _ in range(n):
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_simhash(spark):
    rng = random.Random(5)
    long_ = words(rng, 400)
    texts = [long_, long_ + " end", long_.upper(), None, "", " \t ", "Two words", "two words", "one", words(rng, 60), long_.replace("a", "b", 1)] + [words(rng, 30) for _ in range(30)]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(documents(spark, texts), size=3, radius=2).collect()}
    fp = [fingerprint(t) for t in texts]
    low = smallest(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin(fp[i] ^ fp[j]).count("1") <= 2])
    assert got == {i: (fp[i], low[i]) for i in range(len(texts))}
    left = simhash.drop_near_copies(documents(spark, texts), size=3, radius=2)
    assert {r.doc_id for r in left.collect()} == set(low) and left.columns == documents(spark, texts).columns


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 64))
    rows = [[float(x) for x in centres[i % 6] + rng.normal(size=64) * rng.choice([0.05, 0.3, 0.6])] for i in range(150)]
    rows += [None, [0.0] * 64, [float("nan")] * 64, rows[0], rows[0]]
    labels = [i % 6 % 2 for i in range(150)] + [0, 0, 0, 0, None]
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(rows, labels))], "vec_id long, embedding array<float>, label int")
    v = np.array([np.zeros(64) if r is None else np.nan_to_num(np.array(r, np.float32).astype(float)) for r in rows])
    n = np.linalg.norm(v, axis=1)
    ok = n > 0
    cos = v @ v.T / np.outer(np.where(ok, n, 1), np.where(ok, n, 1))
    linked = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if ok[i] and ok[j] and labels[i] is not None and labels[i] == labels[j] and cos[i, j] >= 0.93]
    links = [sum(i in p for p in linked) for i in range(len(rows))]
    low = smallest(len(rows), linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, threshold=0.93).collect()}
    assert got == {i: (links[i], low[i], low[i] == i) for i in range(len(rows))}


def test_decontamination(spark):
    rng = random.Random(9)
    item = "A train leaves Paris at 9 with 40 people and drives 120 km to Lyon before it stops for 15 minutes in a small town"
    other = item.replace("40", "75").replace("Paris", "Rome").replace("120", "260")
    docs = documents(spark, [words(rng, 50) + " " + item + " " + words(rng, 30), words(rng, 40) + " " + other + " " + words(rng, 9), words(rng, 200), None, ""])
    bench = spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(docs, bench).collect()} == {0, 1}
    assert {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == {2, 3, 4}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_chat(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello é"), (1, 2, "Ann", None), (2, 0, None, "x")], "conv_id long, turn long, role string, text string")
    rows = chat.rotate(df).collect()
    assert {(r.conv_id, r.perspective) for r in rows} >= {(1, "user"), (1, "assistant"), (1, "Ann")}
    assert all(r.rendered is not None for r in rows)
    assert chat.rotate(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    docs = documents(spark, [words(rng, rng.randint(1, 40)) for _ in range(300)] + [None, ""])
    rows = mixing.mix(docs, weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0).collect()
    assert len(rows) == 302 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.target, []).append(r)
    for target, own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= 80
        assert target <= 2 * own[0].source_size + 1e-6
    again = mixing.mix(docs.repartition(5), weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_licenses(spark):
    rows = licenses.scan(documents(spark, ["x CC-BY y", "GNU General Public License", "All rights\nreserved. cc by", None, "", "cc byé"])).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [(1, 1, 1, "cc-by"), (1, 1, 1, "gpl"), (2, 0, 3, "cc-by,reserved"), (0, None, None, ""), (0, None, None, ""), (0, None, None, "")]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_urls(spark):
    pages = ["http://WWW.Example.com/en/a?x#y", "https://a.example.com/en/", "http://b.net/es/1", "http://b.net/fr", "nothing", None, "http://q.com#z", "http://evilexample.com/en/x"]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(pages)], "page_id long, url string, html string")
    got = [(r.host, r.path, r.rule) for r in urls.judge(df, rules=urls.RULES).orderBy("page_id").collect()]
    assert got == [("www.example.com", "/en/a", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("b.net", "/es/1", "net/es/"), ("b.net", "/fr", None), ("", "", None), ("", "", None), ("q.com", "", None), ("evilexample.com", "/en/x", "com/")]


def test_one_site_says_nothing_about_another(spark):
    """Labels of a template count elsewhere from three sites on, each site once however many pages and hosts it has."""
    pages = [f"http://w{i % 5}.big.com/en/{i}" for i in range(60)] + ["http://x.org/en/1", "http://y.net/de/5"] + [f"http://s{i}.net/de/{k}" for i in range(2) for k in range(9)]
    rules = (("block", "big.com/en/"), ("block", "s0.net/de/"), ("block", "s1.net/de/"))
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, rules=rules).collect()}
    assert {got[i].verdict for i in range(60)} == {"block"} and (got[60].verdict, got[60].scope) == ("block", None) and got[60].purity == 1.0  # all labelled pages are blocked
    more = urls.judge(df, rules=(*rules, ("allow", "y.net/zz/"), *(("allow", f"w{i}.big.com/en/{i}") for i in range(3))), reject=0.97).collect()
    assert {r.page_id: (r.verdict, r.scope) for r in more}[61] == ("allow", None)
    three = urls.judge(df, rules=(*rules, ("block", "big.com/de/")), sites=2).collect()
    assert {r.page_id: r.scope for r in three}[61] == "domain"


def test_tokens(spark):
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.count_tokens(documents(spark, ["the the cat", "", None, "the"])).collect()}
    assert got[1] == got[2] == (0, 0) and got[0][0] == 3 and got[3][0] == 1 and got[0][1] >= 2 * got[3][1]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.1"])
def test_quality_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    even = labels.filter("doc_id % 2 = 0")
    got = quality.classify(docs, even).join(labels.filter("doc_id % 2 = 1 AND quality IS NOT NULL"), "doc_id")
    right = got.agg(F.avg((F.col("keep") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("int"))).first()[0]
    assert right > 0.95
    kept = {(r.bad, r.toxic): r.kept for r in got.groupBy((F.col("quality") == 0).alias("bad"), "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert kept[False, 0] > 0.98 and kept[False, 1] < 0.2 and kept[True, 0] < 0.2


#: Columns whose names an operator might use itself
CLASH = "id id0 item start stop size w n t s g held quality harmless toxic keep kept taken target share word words label labels hash h fp key u v a b m c node component component_id part piece salt cell bucket row pos path host rule score position text_id".split()


@pytest.mark.parametrize("name", ["leaks", "without_leaks", "cut_repeats", "without_repeats", "groups", "drop", "mix", "scan", "tokens"])
def test_clashing_columns(spark, name):
    rng = random.Random(4)
    base = words(rng, 200)
    docs = documents(spark, [base, base + " x", None, "", words(rng, 40), "all rights reserved cc by", "the the cat"])
    bench = spark.createDataFrame([(0, base[:300]), (1, None)], "item_id long, text string")
    calls = {
        "leaks": lambda d: decontam.leaks(d, bench),
        "without_leaks": lambda d: decontam.without_leaks(d, bench),
        "cut_repeats": lambda d: suffix_dedup.cut_repeats(d, depth=400),
        "without_repeats": lambda d: suffix_dedup.without_repeats(d, depth=400),
        "groups": lambda d: simhash.simhash_groups(d, size=3, radius=2),
        "drop": lambda d: simhash.drop_near_copies(d, size=3, radius=2),
        "mix": lambda d: mixing.mix(d, weights=(5.0, 2.0, 1.0), share=1.5, max_epochs=2.0),
        "scan": licenses.scan,
        "tokens": tokens.count_tokens,
    }
    wide = docs.select("*", *[F.lit("mine").alias(c) for c in CLASH])
    plain, clash = calls[name](docs), calls[name](wide)
    if name in ("without_leaks", "without_repeats", "drop"):
        assert clash.columns == wide.columns and clash.filter(" or ".join(f"`{c}` <> 'mine'" for c in CLASH)).count() == 0
    rows = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
    assert rows(clash) == rows(plain)


def test_quality_edges(spark):
    docs = documents(spark, ["good text here"] * 5 + [None, "", "x" * 3_000_000])
    none = docs.limit(0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 8 and all(r.keep and r.score == 0.5 and r.harmless == 1 for r in rows)
    assert quality.classify(docs.limit(0), none).count() == 0
    extra = docs.withColumn("quality", F.lit("mine")).withColumn("held", F.lit(1)).withColumn("toxic", F.lit(2)).withColumn("keep", F.lit(3))
    labels = spark.createDataFrame([(0, 1, None), (0, 0, 1), (None, 1, 1), (1, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    left = quality.good_documents(extra, labels)
    assert left.columns == extra.columns and left.count() == 8
    assert quality.classify(docs, labels.drop("toxic")).count() == 8


def test_clashing_columns_of_other_tables(spark):
    mine = [F.lit("mine").alias(c) for c in CLASH if c not in ("label", "role", "turn", "host", "path")]
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, None, 1), (3, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    talk = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "assistant", "Yo"), (1, 1, "assistant", "Yo"), (2, None, None, "")], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(0, "http://a.com/en/1", ""), (0, "http://a.com/en/1", ""), (None, None, None)], "page_id long, url string, html string")
    rows = lambda df, names: sorted(map(repr, df.select(*names).collect()))
    for call, df in ((lambda d: embed_dedup.near_duplicates(d, threshold=0.93), vectors), (chat.rotate, talk), (lambda d: urls.judge(d, rules=urls.RULES), pages)):
        plain = call(df)
        assert rows(call(df.select("*", *mine)), plain.columns) == rows(plain, plain.columns)
        assert call(df.limit(0)).count() == 0


def filled(sizes, share, epochs):
    """Targets by capped water-filling, from each source's size; weights 5, 2, 1 in turn."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left, own = total - sum(epochs * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / own for s in names}
        over = {s for s in names if target[s] > epochs * sizes[s] + 1e-9} - full
        if not over:
            return target
        full |= over


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    items = [i.text or "" for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    states, at = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        states.append(at)
    texts = [{r.doc_id: r.text for r in s.collect()} for s in states]

    model = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(texts[1]) == {r.doc_id for r in model.collect() if r.keep}

    ids = sorted(texts[1])
    fp = [fingerprint(texts[1][i]) for i in ids]
    low = smallest(len(ids), [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (fp[i] ^ fp[j]).bit_count() <= 2])
    ids = [ids[i] for i in sorted(set(low))]
    sets = [five_words(texts[1][i]) for i in ids]
    low = smallest(len(ids), [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert texts[2] == {ids[i]: texts[1][ids[i]] for i in set(low)}

    ids = sorted(texts[2])
    assert texts[3] == dict(zip(ids, brute_left([texts[2][i] for i in ids])))

    grams = lambda text, size: (lambda w: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})(re.findall(r"\w+", (text or "").lower()))
    shared = lambda size: {i for i in texts[3] if grams(texts[3][i], size) & set().union(*(grams(t, size) for t in items))}
    gone = set(texts[3]) - set(texts[4])
    assert set() < shared(20) <= gone <= shared(3)
    assert all(texts[4][i] == texts[3][i] for i in texts[4])

    source = {r.doc_id: r.source for r in states[4].collect()}
    words_of = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts[4].items()}
    sizes = {s: sum(words_of[i] for i in source if source[i] == s) for s in set(source.values())}
    target = filled(sizes, 1.5, 2.0)
    rows = steps["mixing sources to target weights"](spark, states[4], sf_dir).collect()
    assert all(0 < r.taken <= 2 * words_of[r.doc_id] and r.text == texts[4][r.doc_id] and abs(r.target - target[source[r.doc_id]]) < 1e-6 for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    for s, own in sizes.items():
        assert abs(sum(r.taken for r in rows if source[r.doc_id] == s) - target[s]) <= max([words_of[i] for i in source if source[i] == s])
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, sf_dir).collect()}
