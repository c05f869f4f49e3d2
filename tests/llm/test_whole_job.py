"""Cases that the operators once cut short."""

import random

import pytest

from offerloom.llm import decontam, licenses, tokens

from .test_llm import brute_cut, documents, words


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("sf_dir", [None, "/root/testdata/sf0.01"])
def test_stage_drops_near_copies(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(11)
    base = words(rng, 200).split()
    changed = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(5, 195, 5)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if sf_dir else documents(spark, [" ".join(base), *changed, "other words", words(rng, 200), None, "  "])
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = {i: five(t) for i, t in texts.items()}
    by = {}
    for i in left:
        for g in sets[i]:
            by.setdefault(g, set()).add(i)
    assert not [(i, j) for i in left for j in set().union(*(by[g] for g in sets[i])) if i < j and near(sets[i], sets[j])]
    for i in set(texts) - left:  # what goes has a near copy with a smaller doc_id or is linked to one
        assert any(j != i and (near(sets[i], sets[j]) if sets[i] else not sets[j]) for j in texts)
    if not sf_dir:
        assert left == {0, len(changed) + 1, len(changed) + 2, len(changed) + 3}


@pytest.mark.parametrize("sf_dir", [None, "/root/testdata/sf0.001"])
def test_stage_cuts_passages_of_over_50_words(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(12)
    short = lambda n: " ".join("".join(rng.choices("abcdefgé", k=rng.randint(2, 4))) for _ in range(n))
    passage, fifty = short(51), short(50)
    assert len(passage.encode()) < 400
    long_ = "".join(rng.choices("xyz", k=450))
    mine = [f"{short(30)} {passage} {short(20)}", f"{short(9)} {passage.replace(' ', chr(10))}", f"{short(30)} {fifty} {short(4)}", f"{fifty} {short(9)}", f"a {long_} b", f"c {long_} d", None, "", f"{passage[:-1]} {short(60)}"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if sf_dir else documents(spark, mine)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.text or "" for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    split = {i: t.encode().split() for i, t in texts.items()}
    seen = {}
    for i, w in split.items():
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), []).append((i, k))
    gone = {i: set() for i in split}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + 51))
    cut = brute_cut(list(texts.values()))
    for n, i in enumerate(texts):
        left = [w for k, w in enumerate(split[i]) if k not in gone[i]]
        if not cut[n][1]:  # no bytes go by the other rule
            assert got[i].encode().split() == left
        else:
            assert len(got[i].encode().split()) <= len(left) + 2
    if not sf_dir:
        assert passage not in got[0] and passage.split()[9] + chr(10) not in got[1] and fifty in got[2] and fifty in got[3]
        assert long_ not in got[4] and got[8] == texts[8]


def leaked(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id, r.kind) for r in decontam.leaks(documents(spark, texts), bench).collect()}


def test_names_at_sentence_starts(spark):
    rng = random.Random(13)
    tom = "Tom has 5 apples. Tom gives 2 to Ann. How many apples does Tom have?"
    trip = "every morning the old bus of Ann carries 25 people from the harbour to the market and then goes back for the mail"
    texts = [
        f"{words(rng, 30)}. Lily has 7 apples. Lily gives 3 to Ann. How many apples does Lily have? {words(rng, 9)}",
        f"{words(rng, 9)} {trip.replace('Ann', 'Mary Ann').replace('25', 'twenty-five')} {words(rng, 9)}",
        "Lily has a cat. How many dogs does Ann have? Tom went home.",
    ]
    assert leaked(spark, [tom, trip], texts) == {(0, 0, "changed"), (1, 1, "changed")}


def test_one_odd_place_leaves_the_match(spark):
    rng = random.Random(14)
    fruit = "Yesterday the boy bought 5 apples and 5 pears at the market near his house"
    long_ = " ".join(words(rng, 25).split()) + " about 40 people and then " + " ".join(words(rng, 20).split()) + " with 40 people"
    texts = [f"{words(rng, 9)}. {fruit.replace('5 apples', '7 apples').replace('5 pears', '3 pears')} {words(rng, 9)}", f"{words(rng, 9)} {long_[::-1].replace('04', '14', 1)[::-1]}", f"{words(rng, 9)} {long_[:-9]} 90 people", f"so {'the old man Ann sees the red house by the long river every day'.replace('Ann', 'ANN')}"]
    items = [fruit, long_, "so the old man Ann sees the red house by the long river every day"]
    got = leaked(spark, items, texts)
    assert {(d, i) for d, i, _ in got} == {(0, 0), (1, 1), (2, 1), (3, 2)} and (3, 2, "verbatim") in got


def test_copies_of_items_with_few_words(spark):
    rng = random.Random(15)
    items = ["Compute 12 + 34 * 56 - 78", "Ann Lee, 3 May 1950; Bob Roe, 7 June 1961; Carl Poe, 11 July 1972; Dora Moe, 2 April 1983", "7 + 8 = 15"]
    texts = [f"{words(rng, 20)} {i} {words(rng, 9)}" for i in items] + ["Compute 12 + 34 * 56 - 79", "May 1950 and June 1961", "7 + 8 = 16"]
    assert leaked(spark, items, texts) == {(0, 0, "verbatim"), (1, 1, "verbatim"), (2, 2, "verbatim")}


def test_long_pretokens_are_whole(spark):
    rng = random.Random(16)
    texts = ["the" * 40, "日本語" * 400, "https://example.com/" + "".join(rng.choices("abcdef/?=&é", k=300)), "x" * 100_000, "the cat " + "a" * 70]
    model = tokens.Unigram(tokens.load_pieces(tokens.MODEL))
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.count_tokens(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        if len(t) < 5000:
            assert got[i] == (len(t.split()), sum(model.counts(t.split())))  # the trie takes words of any length
    assert got[3][0] == 1
    for step in (1, 7, 64):
        assert [model.count_long(t.encode(), step) for t in texts[:3]] == model.counts(texts[:3])


def test_license_among_many_notices(spark):
    notices = {label: notice for label, notice, _ in licenses.TEMPLATES}
    file = " ".join(notices[x] for x in ("bsd", "mit-text", "isc", "mpl-2.0", "cc0-1.0", "mit", "apache-2.0"))
    common = ["license licensed version public"] * 40 + ["apache"] * 20
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, [file, *common, notices["apache-2.0"]])).collect()}
    assert set(rows[0].labels.split(",")) >= {"apache-2.0", "bsd", "cc0-1.0", "isc", "mit", "mit-text", "mpl-2.0"} and rows[0].score == 1.0
    assert "apache-2.0" in rows[len(common) + 1].labels
