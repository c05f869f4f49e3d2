"""Exchanged values of re-parameterised benchmark items, and how many such items are found."""

import random

import pytest

from offerloom.llm import decontam

from .test_llm import documents, words


def brute_strays(slots):
    """The least number of places to drop so that values are exchanged one for one, by trying all choices."""
    places = list(slots.values())
    best = len(places)
    for mask in range(1 << len(places)):
        kept = [x for i, x in enumerate(places) if mask >> i & 1]
        if len({a for a, _ in kept}) == len({b for _, b in kept}) == len(set(kept)):
            best = min(best, len(places) - len(kept))
    return best


def test_strays():
    rng = random.Random(61)
    assert decontam.strays({0: ("Paris", "Rome"), 1: ("Lyon", "Rome")}) == 1
    assert decontam.strays({0: ("5", "7"), 1: ("5", "3")}) == 1
    assert decontam.strays({0: ("5", "7"), 1: ("7", "5")}) == 0
    for _ in range(300):
        slots = {i: (rng.choice("ab"), rng.choice("xy")) for i in range(rng.randint(0, 7))}
        assert brute_strays(slots) <= decontam.strays(slots) <= 2 * brute_strays(slots) + 1


def found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_item, r.n_matched, r.kind) for r in decontam.leaks(documents(spark, texts), bench).collect()}


def test_values_are_exchanged_one_for_one(spark):
    item = "The train from Paris to Lyon takes 2 hours and Ann sits in it"  # 13 words or more, places among them
    got = found(spark, [item], [item.replace("Paris", "Rome").replace("Lyon", "Oslo"), item.replace("Paris", "Rome").replace("Lyon", "Rome"), item.replace("Paris", "Lyon").replace("Lyon to Lyon", "Lyon to Paris")])
    assert got[0, 0][2] == "changed" and got[0, 0][1] == got[0, 0][0]
    assert got.get((1, 0), (0, -1, ""))[1] < got[0, 0][1]  # the place doesn't count
    assert got[2, 0][1] == got[2, 0][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_of_changed_questions(spark, seed):
    """Questions with new numbers, names and units, each exchanged one for one, in documents of other words."""
    rng = random.Random(seed)
    names, more = ["Tom", "Ann", "Mary", "Peter"], ["Olga", "Hugo", "Ivan", "Rita"]
    items, texts = [], []
    for _ in range(40):
        a, b = rng.sample(names, 2)
        n, m = rng.sample(range(12, 99), 2)
        body = words(rng, 14)
        items.append(f"{a} buys {n} kg of {body} and gives {m} to {b} who keeps {n} of them")
        c, d = rng.sample(more, 2)
        p, q = rng.sample(range(112, 999), 2)
        changed = f"{c} buys {p} kg of {body} and gives {q} to {d} who keeps {p} of them"
        texts.append(f"{words(rng, 40)}. {changed} {words(rng, 30)}")
    clean = [f"{words(rng, 90)}" for _ in range(40)]
    got = found(spark, items, texts + clean)
    right = {(i, i) for i in range(40)}
    assert len(right & set(got)) >= 36 and set(got) <= right and {got[x][2] for x in right & set(got)} == {"changed"}
