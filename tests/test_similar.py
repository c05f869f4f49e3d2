"""Similarity joins and one-use assignment against all pairs in memory."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from offerloom.functions import similarity as M
from offerloom.functions import text as T
from offerloom.operators import joins, similar
from offerloom.plans import market


def texts(spark, values, name="s"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_overlapping(spark, least):
    rng = random.Random(3)
    words = ["brand", *(f"w{i}" for i in range(12))]
    sets = [(i, sorted(set(["brand"] * (rng.random() < 0.9) + rng.sample(words, rng.randint(1, 6))))) for i in range(200)]
    df = spark.createDataFrame(sets, "k long, t array<string>")
    both = {(a, b): (len(set(x) & set(y)), max(len(x), len(y)), len(set(x) | set(y))) for a, x in sets for b, y in sets if a < b}
    assert {(r.a, r.b): r.shared for r in similar.overlapping(df, "k", "t", least).collect()} == {k: c for k, (c, n, _) in both.items() if c >= least * n - 1e-9}
    assert {(r.a, r.b) for r in similar.jaccard_pairs(df, "k", "t", least).collect()} == {k for k, (c, _, u) in both.items() if c / u >= least - 1e-9}


def test_a_common_token_stays_out_of_the_prefix(spark):
    """Every set holds one token; pairs that meet are those that share a rare one too."""
    df = spark.range(2000).selectExpr("id AS k", "array('all', concat('r', id div 2), concat('s', id), concat('t', id)) AS t")
    pairs = similar.overlapping(df, "k", "t", 0.5)
    assert {(r.a, r.b) for r in pairs.select("a", "b").collect()} == {(i, i + 1) for i in range(0, 2000, 2)}


def test_classes(spark):
    df = spark.createDataFrame([(3, ["a", "b"]), (1, ["b", "a", None, "a"]), (2, ["c"]), (4, []), (5, None)], "k long, t array<string>")
    assert sorted((r.k, r.rep) for r in similar.classes(df, "k", F.col("t")).collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.75, 1.0])
def test_similar_names(spark, least):
    rng = random.Random(4)
    names = sorted({" ".join(rng.choices(["red", "red", "bolt", "12개입", "cup", "세트", "box", "AB-1"], k=rng.randint(1, 5))) for _ in range(60)}) + ["", "!!", None]
    df = texts(spark, names, "n")
    pairs = df.select(F.col("n").alias("a")).crossJoin(df.select(F.col("n").alias("b"))).filter("a < b")
    score = M.token_similarity(T.name_tokens(F.col("a")), T.name_tokens(F.col("b")))
    want = {(r.a, r.b): round(r.s, 9) for r in pairs.select("a", "b", score.alias("s")).collect() if r.s >= least - 1e-9}
    assert {(r.a, r.b): round(r.token_sim, 9) for r in similar.similar_names(df, "n", least).collect()} == want


def test_bounds_lose_no_match(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("abcde ", k=rng.randint(0, 9))), "".join(rng.choices("abcde ", k=rng.randint(0, 9)))) for _ in range(300)] + [("abc", None), (None, None), ("x" * 300, "x" * 250)]
    df = spark.createDataFrame(rows, "a string, b string")
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    for least in (0.5, 0.9):
        got = sorted((r.a, r.b, round(r.ratio, 9)) for r in similar.fuzzy_matches(df, "a", "b", least).collect())
        assert got == sorted((a, b, round(ratio(a, b), 9)) for a, b in rows if ratio(a, b) >= least - 1e-9)
    bounds = similar.with_bounds(df, "a", "b").filter("a <> '' AND b <> ''").collect()
    assert all(ratio(r.a, r.b) <= r.by_letters + 1e-9 <= r.by_length + 2e-9 for r in bounds)


@pytest.mark.parametrize("least", [0.25, 0.4, 0.5, 0.7])
def test_common_substrings(spark, least):
    rng = random.Random(6)
    made = ["".join(rng.choices("abcd_1", k=rng.randint(1, 14))) for _ in range(120)] + [f"image_{i}" for i in range(30)] + ["", None, "é" * 9]
    left, right = made[:90] + made[-3:], made[60:]

    def longest(x, y):
        return SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y)).size

    want = {(x, y): round(longest(x, y) / max(len(x), len(y)), 9) for x in left if x for y in right if y if longest(x, y) / max(len(x), len(y)) > least + 1e-9}
    assert {(r.x, r.y): round(r.ratio, 9) for r in similar.common_substrings(texts(spark, left), texts(spark, right), least).collect()} == want
    assert {tuple(r) for r in similar.containing(texts(spark, left), texts(spark, right)).collect()} == {(x, y) for x in left if x and len(x) >= 3 for y in right if y and x in y}


def test_local_images_by_likeness(spark):
    urls = spark.createDataFrame([(f"http://h/{u}",) for u in ("exact.jpg", "ringbox7.png", "blue_mug_2020.jpg", "zzz.jpg")], "url string")
    files = spark.createDataFrame([(n,) for n in ("exact.jpg", "old_ringbox7_v2.jpg", "a_ringbox7.jpg", "xblue_mug_2021.jpg", "q.jpg")], "name string")
    plain = {r.url[9:]: r.local for r in joins.local_images(urls, files).collect()}
    assert plain == {"exact.jpg": "exact.jpg", "ringbox7.png": None, "blue_mug_2020.jpg": None, "zzz.jpg": None}
    found = {r.url[9:]: r.local for r in joins.local_images(urls, files, fuzzy=0.4, contains=True).collect()}
    assert found == plain | {"ringbox7.png": "a_ringbox7.jpg", "blue_mug_2020.jpg": "xblue_mug_2021.jpg"}


def test_tfidf(spark):
    """Cosines of grams counted in memory; the best are those of all pairs."""
    import math
    from collections import Counter

    rng = random.Random(7)
    words = ["red", "bolt", "cup", "box", "세트", "mugs", "mug", "ab"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(70)})

    def grams(t):
        return Counter(p[i : i + n] for w in t.lower().split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(len(p) - n + 1))

    df = Counter(g for t in names for g in grams(t))
    idf = {g: math.log((1 + len(names)) / (1 + n)) + 1 for g, n in df.items() if 2 <= n <= 0.9 * len(names)}

    def vector(t):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in grams(t).items() if g in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()}

    v = {t: vector(t) for t in names}
    cosine = lambda a, b: round(sum(x * v[b].get(g, 0) for g, x in v[a].items()), 6)
    for k, seeds in ((1, 1), (4, 3), (1000, 2)):
        got = {(r.query, r.rank): (r.text, r.score) for r in similar.top_by_tfidf(texts(spark, names[::7], "t"), texts(spark, names, "t"), k, seeds).collect()}
        want = {(a, i + 1): (b, s) for a in names[::7] for i, (b, s) in enumerate(sorted(((b, cosine(a, b)) for b in names if set(v[a]) & set(v[b])), key=lambda x: (-x[1], x[0]))[:k])}
        assert got == want
    pairs = spark.createDataFrame([(a, b) for a in names[:20] for b in names[-20:]] + [(n, n) for n in names], "a string, b string")
    assert all(abs(r.tfidf - cosine(r.a, r.b)) < 2e-6 for r in M.tfidf_cosine(pairs, "a", "b").collect())
    assert {r.tfidf for r in M.tfidf_cosine(pairs.limit(3), "a", "b").collect()} == {0.0}


@pytest.mark.parametrize("seed", range(3))
def test_one_use_is_the_sequential_order(spark, seed):
    rng = random.Random(seed)
    turn = {p: rng.randint(0, 9) for p in range(40)}
    place = {i: rng.randint(0, 5) for i in range(50)}
    pairs = [(p, i, turn[p], place[i]) for p in turn for i in place if rng.random() < (0.1, 0.4, 0.02)[seed]]
    used, want = set(), set()
    for p in sorted(turn, key=lambda p: (turn[p], p)):
        for _, i in sorted((place[i], i) for q, i, _, _ in pairs if q == p):
            if i not in used:
                used.add(i)
                want.add((p, i))
                break
    df = spark.createDataFrame(pairs + pairs[:5], "p long, i long, lo long, ro long")
    assert {tuple(r) for r in joins.one_use(df, "p", "i", "lo", "ro").collect()} == want


def test_one_use_of_classes_is_one_use(spark):
    rng = random.Random(5)
    p, i = [(g, rng.randint(0, 6), x, rng.randint(0, 3)) for x in range(60) for g in [rng.choice("ab")]], [(g, rng.randint(0, 4), 100 + x, rng.randint(0, 3)) for x in range(50) for g in [rng.choice("abc")]]
    likes = [(a, b) for a in range(7) for b in range(5) if rng.random() < 0.5]
    lefts, rights = spark.createDataFrame(p + [(None, 0, 999, 0)], "group string, class long, id long, turn int"), spark.createDataFrame(i + [(None, 0, 998, 0)], "group string, class long, id long, place int")
    pairs = spark.createDataFrame([(x, y, t, o) for g, a, x, t in p for h, b, y, o in i if g == h and (a, b) in likes], "p long, i long, lo long, ro long")
    got = {tuple(r) for r in joins.one_use_of_classes(lefts, rights, spark.createDataFrame(likes, "left long, right long")).collect()}
    assert got == {tuple(r) for r in joins.one_use(pairs, "p", "i", "lo", "ro").collect()} and len(got) > 20


def test_top_by_tfidf_is_the_same_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    names = texts(spark, [" ".join(rng.choices(["red", "blue", "old", "bolt", "ring", "plate", "anvil"], k=3)) for _ in range(120)], "t")
    whole = similar.top_by_tfidf(names, names, 4)
    monkeypatch.setattr(similar, "BLOCK", 25)
    cut = similar.top_by_tfidf(names, names, 4)
    assert whole.count() > 300 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[0]


def test_a_common_name_is_no_single_task(spark):
    products = spark.createDataFrame([(i, "x ") for i in range(200)] + [(200, "y"), (201, None)], "id int, product_name string")
    offers = spark.createDataFrame([(j, "x") for j in range(30)], "o int, product_name string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = joins.offers_of(products, offers, trim=True)
        assert got.columns == ["id", "product_name", "o"]
        rows = got.select("id", "o", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.id, -1 if r.o is None else r.o) for r in rows) == [(i, j) for i in range(200) for j in range(30)] + [(200, -1), (201, -1)]
    assert len({r.at for r in rows if r.o is not None}) > 2


def test_names_are_scored_once(spark):
    """No filter takes the text score with it, to have it worked out twice."""
    plan = market.matched_by_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2, plan.count("ArrowEvalPython")


def test_three_similar(spark):
    products = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B")], "ordinal int, product_name string")
    images = [("base", "b0", "A", 0), ("base", "b1", "A", 1), ("k", "k0", "A", 0), ("k", "k1", "A", 1), ("k", "k2", "A", 2), ("n", "n0", "A", 0), ("n", "n1", "B", 1)]
    files = spark.createDataFrame(images, "source string, path string, n string, ordinal int").withColumn("product_hash", T.name_hash(F.col("n"))).drop("n")
    scores = spark.createDataFrame([("b0", "k0", 0.1), ("b0", "k1", 0.9), ("b1", "k1", 0.9), ("b1", "k0", 0.7), ("b1", "n0", 0.2), ("b0", "n0", 0.3), ("k2", "n0", 0.8)], "a string, b string, score double")
    got = {r.ordinal: (r.base, r.k, r.n) for r in joins.three_similar(products, files, scores, 0.65).collect()}
    assert got == {0: ("b0", "k1", None), 1: ("b1", "k0", None), 2: (None, "k2", "n0"), 3: (None, None, "n1")}
