"""Rows that share an id, talks and paths of any length, groups in several blocks, empty tables, very long texts, ties and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom.llm import align, chat, decontam, embed_dedup, jaccard, licenses, manifest, mixing, quality, simhash, substring_dedup, suffix_dedup, tokens, urls
from offerloom.llm.common import Scratch, components

from .test_llm import DOCS, brute_cut, documents, fingerprint, five_words, smallest, words


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.source or "") for r in df.collect())


def test_rows_go_by_id_and_text(spark):
    rng = random.Random(21)
    a, b, c = (words(rng, 120) for _ in range(3))
    near = a.split()
    near[60] = "other"
    rows = [(0, a, "x"), (5, a, "y"), (5, b, "y"), (7, " ".join(near), "z"), (7, c, "z"), (9, b, "q"), (9, b, "p"), (5, b, "x"), (None, a, "n"), (None, None, "n")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    left = rows_of(simhash.drop_near_copies(docs, size=3, radius=2))
    assert (5, b, "x") in left and (0, a, "x") in left and (7, c, "z") in left and (-1, a, "n") in left
    assert not [r for r in left if r[:2] in ((5, a), (9, b))] and len([r for r in left if r[:2] == (5, b)]) == 1
    left = rows_of(jaccard.drop_similar(docs))
    assert left == sorted([(0, a, "x"), (5, b, "x"), (7, c, "z"), (-1, a, "n"), (-1, "", "n")])
    bench = spark.createDataFrame([(0, a[:300])], "item_id long, text string")
    left = rows_of(decontam.without_leaks(docs, bench))
    assert left == sorted([(5, b, "y"), (7, c, "z"), (9, b, "q"), (9, b, "p"), (5, b, "x"), (-1, "", "n")])


@pytest.mark.parametrize("block", [3, 1024])
def test_similar_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(22)
    texts = []
    for size in (60, 90, 140):
        base = words(rng, size).split()
        for _ in range(16):
            own = list(base)
            for k in rng.sample(range(size), rng.randint(0, size // 30)):
                own[k] = words(rng, 1)
            texts.append(" ".join(own))
    texts += [words(rng, 40) for _ in range(10)] + ["a b", "a b", "A  b", "", None]
    rng.shuffle(texts)
    sets = [five_words(t) for t in texts]
    low = smallest(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert {r.doc_id for r in jaccard.drop_similar(documents(spark, texts)).collect()} == set(low)


def test_a_long_talk_is_one_row_a_view(spark):
    turns = [(1, i, ("Ann", "Bob", "assistant")[i % 3], f"t{i}") for i in range(600)]
    df = spark.createDataFrame(turns + [(2, 0, "Ann|>\n<|assistant|>", "x <|end|>"), (2, 1, "Bo", "y"), (3, 0, "system", "z")], "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(rows) == {(1, "Ann"), (1, "Bob"), (1, "assistant"), (2, "Ann|>\n<|assistant|>"), (2, "Bo")}
    for (conv, who), r in rows.items():
        if conv == 1:
            want = "".join((f"<|assistant|>\n" if role == who else f"<|user name={role}|>\n") + f"{t}<|end|>\n" for _, _, role, t in turns)
            assert r.rendered == want and r.n_turns == 600 and r.chunk == 0
            own = [r.rendered[int(s.split("-")[0]) : int(s.split("-")[1])] for s in r["mask"].split(",")]
            assert own == [f"{t}<|end|>\n" for _, _, role, t in turns if role == who]
    assert rows[2, "Bo"].rendered.count("<|assistant|>") == 1 and rows[2, "Bo"].rendered.count("<|end|>") == 2
    assert max(r.n_turns for r in chat.rotate(df, chunk_turns=100).collect()) == 100


def test_tree_judges_hosts_without_rules(spark):
    rng = random.Random(23)
    pages = [f"http://{'www.' if h % 2 else ''}h{h}.net/{lang}/{rng.randint(1, 10**6)}" for h in range(40) for lang in ("es", "en", "de") for _ in range(4)]
    rules = tuple(("block", f"h{h}.net/es/") for h in range(30)) + tuple(("allow", f"h{h}.net/en/") for h in range(30))
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = urls.judge(df, rules=rules).collect()
    held = [r for r in got if int(r.host.removeprefix("www.")[1:-4]) >= 30]
    assert {r.rule for r in held} == {None} and {r.template for r in held} == {"/es/*", "/en/*", "/de/*"}
    right = [r.verdict == ("block" if r.path.startswith("/es/") else "allow") for r in held]
    assert sum(right) == len(held) == 120 and {r.scope for r in held} == {"domain", None}


def test_tree_is_as_deep_as_the_paths(spark):
    pages = [f"http://a.net/x/y/z/u/v/{n}/{w}" for n in range(30) for w in ("good", "bad")] + ["http://a.net/x/y/z/u/v/99/bad", "http://a.net/x/y/z/u/v/99/good", "http://b.org/" + "/".join("s" * 3 for _ in range(60))]
    rules = tuple(("block" if w == "bad" else "allow", f"a.net/x/y/z/u/v/{n}/{w}") for n in range(30) for w in ("good", "bad"))
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, rules=rules).collect()}
    assert got[60].template == "/x/y/z/u/v/*/bad" and got[60].verdict == "block" and got[61].verdict == "allow" and got[60].rule is None
    assert got[62].template.count("/") == 60
    none = urls.judge(df, rules=()).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.purity for r in none} == {None}


def test_rules_of_one_length(spark):
    df = spark.createDataFrame([(0, "http://a.com/xx/1"), (1, "http://b.a.com/xx/1")], "page_id long, url string")
    got = {r.rule for r in urls.judge(df, rules=(("block", "a.com/xx/"), ("allow", "a.com/x"))).collect()}
    assert got == {"a.com/xx/"}


OPERATORS = {
    "op1": lambda d, b, y: decontam.leaks(d, b), "op1 stage": lambda d, b, y: decontam.without_leaks(d, b), "op2": lambda d, b, y: suffix_dedup.cut_repeats(d), "op2 stage": lambda d, b, y: suffix_dedup.without_repeats(d, words=51),
    "op4": lambda d, b, y: simhash.simhash_groups(d), "op4 stage": lambda d, b, y: simhash.drop_near_copies(d), "similar": lambda d, b, y: jaccard.drop_similar(d), "op6": lambda d, b, y: mixing.mix(d), "op7": lambda d, b, y: licenses.scan(d),
    "op9": lambda d, b, y: tokens.count_tokens(d), "op10": lambda d, b, y: quality.classify(d, y), "op10 stage": lambda d, b, y: quality.good_documents(d, y),
    "op11": lambda d, b, y: substring_dedup.without_later(d), "op12": lambda d, b, y: align.align(d, "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"), "op13": lambda d, b, y: manifest.manifest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_long_and_repeated(spark, name):
    rng = random.Random(24)
    long_ = words(rng, 150_000)
    base = words(rng, 100)
    texts = [long_, "x" * 400_000, None, "", base, base, long_]
    docs = documents(spark, texts).union(documents(spark, texts[4:5]))  # doc 0 of the second has an id and another text
    bench = spark.createDataFrame([(0, base[:200]), (0, base[:200]), (1, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    call = OPERATORS[name]
    got = call(docs, bench, labels)
    n = got.count()
    assert call(docs.limit(0), bench, labels).count() == 0 and call(docs.limit(0), bench, labels).columns == got.columns
    assert n == {"op1": 3, "op1 stage": 5, "op4 stage": 4, "similar": 5}.get(name, len(texts) + 1)
    if name == "op4":
        rows = {(r.doc_id, r.fp & (1 << 64) - 1) for r in got.collect()}
        assert {(0, fingerprint(long_)), (0, fingerprint(base)), (6, fingerprint(long_)), (2, 0)} <= rows
    if name == "op9":
        assert {(r.doc_id, r.n_pretokens) for r in got.collect()} >= {(0, 150_000), (1, 1), (2, 0), (3, 0)}
    if name == "op11":
        rows = {(r.doc_id, r.n_words, r.n_removed) for r in got.collect()}
        assert rows == {(0, 150_000, 0), (0, 100, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 100, 100), (5, 100, 100), (6, 150_000, 150_000)}
    if name == "op12":
        rows = {r.doc_id: r for r in got.filter("doc_id in (1, 2, 3, 6)").collect()}
        assert rows[1].n_a > 1000 and rows[1].n_groups == rows[1].n_links > 0 and rows[6].n_a >= 150_000
        assert {(rows[i].n_a, rows[i].n_b, rows[i].n_links, rows[i].count_sum, rows[i].groups_sha256) for i in (2, 3)} == {(0, 0, 0, 0, "")}
    if name == "op13":
        assert {r.verified for r in got.collect()} == {True} and len({r.root for r in got.collect()}) == 1
    if name == "op2":
        small = [t if t is None or len(t) < 1000 else None for t in texts]
        want = brute_cut(small)
        assert {r.doc_id: r.n_spans for r in got.filter("doc_id = 3").collect()} == {3: want[3][2]}
        assert {(r.n_bytes, r.n_removed) for r in got.filter("doc_id = 6").collect()} == {(len(long_.encode()), len(long_.encode()))}


def test_long_vectors_paths_and_turns(spark):
    """Operators whose input is no document: nulls, empties, very long values, repeated rows, and empty tables."""
    rng = random.Random(26)
    v = [rng.gauss(0, 1) for _ in range(20_000)]
    vectors = spark.createDataFrame([(0, v, "a"), (1, [x * 3 for x in v], "a"), (1, [x * 3 for x in v], "a"), (2, [], "a"), (3, None, "a"), (4, v, None), (5, [-x for x in v], "a")], "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(vectors).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0
    deep = "http://a.com/" + "/".join(f"s{i}" for i in range(400))
    pages = spark.createDataFrame([(0, deep), (0, deep), (1, "http://b.org/" + "x" * 200_000), (2, None), (3, ""), (4, "://"), (None, "http://a.com/")], "page_id long, url string").withColumn("host", F.lit(1))
    got = sorted((-1 if r.page_id is None else r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in urls.judge(pages).collect())
    assert got == [(-1, "a.com", 1, "com/", "allow"), (0, "a.com", len(deep) - 12, "com/", "allow"), (0, "a.com", len(deep) - 12, "com/", "allow"), (1, "b.org", 200_001, None, "allow"), (2, "", 0, None, "allow"), (3, "", 0, None, "allow"), (4, "", 0, None, "allow")]
    assert urls.judge(pages.limit(0)).count() == 0
    talk = spark.createDataFrame([(1, 0, "Ann", "x" * 300_000), (1, 1, "Bob", None), (1, 1, "Bob", None), (2, 0, None, "y"), (None, 0, "Cy", "z")], "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1))
    rows = chat.rotate(talk).collect()
    assert {(r.conv_id, r.perspective, r.n_turns) for r in rows} >= {(1, "Ann", 3), (1, "Bob", 3)} and max(len(r.rendered) for r in rows) > 300_000
    assert chat.rotate(talk.limit(0)).count() == 0


def test_ties(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 1)] * 6 + [(2, "a b c d", "en", "t", 1)] * 3, DOCS)
    rows = mixing.mix(docs).collect()
    by = {s: sum(r.taken for r in rows if r.source == s) for s in "st"}
    target = {r.source: r.target for r in rows}
    assert len(rows) == 9 and all(abs(by[s] - target[s]) <= 4 and r.taken <= 2 * r["size"] for s in "st" for r in rows)
    assert {r.component_id for r in simhash.simhash_groups(docs).collect()} == {1}
    vectors = spark.createDataFrame([(i % 3, [1.0, 0.0], 1) for i in range(9)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(vectors).collect()} == {(i, 8, 0) for i in range(3)}
    got = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.count_distinct("score")).first()[0]
    assert got == 1


def test_joined_components(spark):
    rng = random.Random(21)
    pairs = lambda n, top: [(rng.randrange(top), rng.randrange(top)) for _ in range(n)]
    for first, more in ((pairs(60, 120), pairs(25, 140)), ([], [(5, 3), (3, 9), (7, 7)]), ([(i, i + 1) for i in range(40)], [(39, 60), (60, 2)]), ([(1, 2)], [])):
        frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
        held = Scratch()
        got = jaccard._joined(held(components(frame(first)), "of"), frame(more), held).collect()
        low = smallest(150, first + more)
        assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == {x: low[x] for p in first + more for x in p if p[0] != p[1] or low.count(low[x]) > 1}


def test_vectors_of_any_magnitude(spark):
    """The cosine, not the squares of components, decides."""
    rng = random.Random(24)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    vectors = [[x * scale for x in v] for v in base for scale in (1e-300, 1e-200, 1.0, 1e200, 1e300)] + [[1e-200, 2e-200, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0], [0.01, 1.0, 0.0, 0.0], [5e-324, 0.0, 0.0, 0.0], [1.7e308, 1.7e308, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string")

    def cosine(v, w):
        v, w = ([x / max(map(abs, u)) for x in u] for u in (v, w))
        return sum(x * y for x, y in zip(v, w)) / (sum(x * x for x in v) * sum(y * y for y in w)) ** 0.5

    n = len(vectors)
    links = [(i, j) for i in range(n) for j in range(i) if cosine(vectors[i], vectors[j]) >= 0.93]
    low = smallest(n, links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df, threshold=0.93).collect()}
    assert got == {i: (sum(i in x for x in links), low[i]) for i in range(n)}


def test_many_equal_rows_are_linear(spark):
    text = words(random.Random(25), 150)
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = suffix_dedup.cut_repeats(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(len(text.encode()), len(text.encode()), 1, 20_000)]
