"""Similarity joins that never make the pairs they would throw away.

Each has a bound that follows from its threshold and turns it into an equi-join on rare pieces: the first tokens of a set in order of rarity, or a few
grams of a text chosen by rarity. What is left is verified exactly. Results are those of comparing all with all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as M
from ..functions import text as T

#: Room for rounding in a bound; a bound that is a little too low costs a comparison, never a pair
EPS = 1e-9
#: Texts of one block of :func:`top_by_tfidf`
BLOCK = 4096


# ---------------------------------------------------------------- sets of tokens
def classes(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, rep, tokens)``: rows with equal token sets share ``rep``, the least key among them. Null and empty sets have none."""
    sets = rows.select(F.col(key), F.array_sort(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))).alias("tokens")).filter(F.size("tokens") > 0)
    return sets.join(sets.groupBy("tokens").agg(F.min(key).alias("rep")), "tokens").select(key, "rep", "tokens")


def overlapping(sets: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """``(a, b, x, y, shared)`` for all pairs ``a < b`` of rows with ``shared >= least * max(size)`` tokens in common.

    ``sets`` has one row for each key and distinct tokens. Tokens are ordered by how many sets hold them, the rarest first. Two sets that share so many must share
    one of their first ``size - ceil(least * size) + 1`` tokens (prefix filter); sizes and places of the first shared token
    bound what can follow (size and positional filters). So a token that most sets hold stands behind the prefix of all but the smallest sets.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and be 1 at most")
    own = sets.select(F.col(key).alias("k"), F.col(tokens).alias("t"))
    each = own.select("k", F.explode("t").alias("t"))
    rarity = each.groupBy("t").agg(F.count("*").alias("n"))
    size = F.size("o")
    ordered = each.join(rarity, "t").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("o"))
    prefix = ordered.select("k", size.alias("size"), F.posexplode(F.slice("o", F.lit(1), size - F.ceil(size * least - EPS).cast("int") + 1)).alias("at", "p")).select("k", "size", "at", F.col("p.t").alias("t"))
    p, q = prefix.toDF("a", "n", "i", "t"), prefix.toDF("b", "m", "j", "t")
    need = F.ceil(F.greatest("n", "m") * least - EPS)
    could = (F.least("n", "m") >= need) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need)
    found = p.join(q, "t").filter(F.col("a") < F.col("b")).filter(could).select("a", "b").distinct()
    pairs = found.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return pairs.filter(F.col("shared") >= F.ceil(F.greatest(F.size("x"), F.size("y")) * least - EPS))


def jaccard_pairs(sets: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """``(a, b, jaccard)`` of all pairs with a Jaccard similarity of ``least`` or more: it never exceeds the share of the larger set."""
    pairs = overlapping(sets, key, tokens, least)
    score = F.col("shared") / (F.size("x") + F.size("y") - F.col("shared"))
    return pairs.select("a", "b", score.alias("jaccard")).filter(F.col("jaccard") >= least - EPS)


def similar_names(names: DataFrame, name: str, least: float) -> DataFrame:
    """``(a, b, jaccard, token_sim)`` of all pairs of distinct names ``a < b`` whose token similarity is ``least`` or more.

    The score is at most ``0.85 r + 0.15``, where ``r`` is the share of the larger token set that both have; so ``r`` must be ``(least - 0.15) / 0.85``.
    ``least`` must be above 0.15. Names without tokens are similar to none.
    """
    if least <= 0.15:
        raise ValueError("least must be above 0.15")
    own = names.select(F.col(name).alias("k")).filter("k is not null").distinct().withColumn("l", T.name_tokens(F.col("k")))
    sets = own.select("k", "l", F.array_distinct("l").alias("t")).filter(F.size("t") > 0)
    pairs = overlapping(sets, "k", "t", (least - 0.15) / 0.85).select("a", "b")
    lists = sets.select("k", "l")
    pairs = pairs.join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b")
    return pairs.select("a", "b", M.jaccard(F.col("x"), F.col("y")).alias("jaccard"), M.token_similarity(F.col("x"), F.col("y")).alias("token_sim")).filter(F.col("token_sim") >= least - EPS)


# ---------------------------------------------------------------- matching blocks
def letter_bag(text: Column) -> Column:
    """The letters of a text, each with how often it stood before: an array of distinct strings whose intersection counts shared letters."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def with_bounds(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with two upper bounds of the block-matching ratio: ``by_length``, if the shorter text matched in full, and ``by_letters``, if all shared letters did."""
    n, m = F.length(a), F.length(b)
    bags = pairs.select(F.explode(F.array(a, b)).alias("t")).filter("t is not null").distinct().withColumn("bag", letter_bag(F.col("t")))
    out = pairs.withColumn("by_length", F.try_divide(2.0 * F.least(n, m), n + m))
    out = out.join(bags.toDF(a, "__x"), a, "left").join(bags.toDF(b, "__y"), b, "left")
    return out.withColumn("by_letters", F.try_divide(2.0 * F.size(F.array_intersect("__x", "__y")), n + m)).drop("__x", "__y")


def fuzzy_matches(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """``pairs`` whose block-matching ratio is ``least`` or more, with ``ratio``. Only pairs that both bounds allow are given to Python."""
    could = with_bounds(pairs, a, b).filter((F.col("by_length") >= least - EPS) & (F.col("by_letters") >= least - EPS)).drop("by_length", "by_letters")
    return could.withColumn("ratio", M.fuzzy_ratio(F.col(a), F.col(b))).filter(F.col("ratio") >= least - EPS)


# ---------------------------------------------------------------- common substrings
def _grams(texts: DataFrame, q: int) -> DataFrame:
    """``(s, n, at, g)``: each gram of ``q`` letters with its place from 0."""
    fits = texts.filter(F.col("n") >= q)
    return fits.select("s", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - q + 1), lambda i: F.substring(F.col("s"), i, F.lit(q)))).alias("at", "g"))


def _probes(left: DataFrame, held: DataFrame, q: int, step: Column) -> DataFrame:
    """Every ``step``-th gram of each text, of the ``step`` ways to choose them the one with the fewest occurrences on the other side."""
    rarity = held.groupBy("g").agg(F.count("*").alias("c"))
    grams = _grams(left, q).withColumn("step", step).withColumn("r", F.col("at") % F.col("step"))
    known = grams.join(rarity, "g", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    best = known.groupBy("s", "r").agg(F.sum("c").alias("c")).groupBy("s").agg(F.min_by("r", F.struct("c", "r")).alias("best"))
    return known.join(best, "s").filter("r = best AND c > 0").select("s", "n", "at", "g")


def longest_run(x: Column, y: Column, shift: Column) -> Column:
    """The longest stretch of equal letters when ``x`` is laid on ``y`` so that its letter ``shift`` stands on the first of ``y``."""
    start = F.greatest(shift, F.lit(0))
    count = F.least(F.length(x), F.length(y) + shift) - start
    same = F.transform(F.sequence(F.lit(1), count), lambda i: F.when(F.substring(x, start + i, F.lit(1)) == F.substring(y, start - shift + i, F.lit(1)), "1").otherwise("0"))
    return F.when(count > 0, F.array_max(F.transform(F.split(F.array_join(same, ""), "0"), lambda part: F.length(part)))).otherwise(0)


def common_substrings(left: DataFrame, right: DataFrame, least: float, q: int = 3) -> DataFrame:
    """``(x, y, ratio)`` of all pairs of distinct texts ``left.s`` and ``right.s`` whose longest common substring is more than ``least`` of the longer text.

    A common substring of ``m`` letters holds ``m - q + 1`` neighbouring grams of ``x`` on one diagonal, so it is enough to look up every ``m - q + 1``-th gram of
    ``x``; which of them is chosen by rarity. Pairs that meet on a diagonal are compared along it. Pairs of texts too short to share ``q`` letters
    by this rule are looked up by single letters.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    texts = lambda df: df.select(F.col("s")).filter("s <> ''").distinct().withColumn("n", F.length("s"))
    a, b = texts(left), texts(right)
    need = lambda n: (F.floor(n * least + EPS) + 1).cast("int")
    short = next(n for n in range(1, int(q / least) + 3) if int(n * least + EPS) + 1 >= q)  # the shortest longer text that must share q letters

    def found(a: DataFrame, b: DataFrame, q: int) -> DataFrame:
        held = _grams(b, q)
        probes = _probes(a, held, q, F.greatest(need(F.col("n")), F.lit(q)) - q + 1)
        met = probes.toDF("x", "n", "i", "g").join(held.toDF("y", "m", "j", "g"), "g").select("x", "y", "n", "m", (F.col("i") - F.col("j")).alias("shift"))
        span = F.least("n", F.col("m") + F.col("shift")) - F.greatest("shift", F.lit(0))
        return met.filter(span >= need(F.greatest("n", "m"))).distinct()

    met = found(a, b, q)
    if short > 1 and q > 1:
        few = F.col("n") < short
        met = met.union(found(a.filter(few), b.filter(few), 1))
    runs = met.withColumn("run", longest_run(F.col("x"), F.col("y"), F.col("shift"))).filter(F.col("run") >= need(F.greatest("n", "m")))
    return runs.groupBy("x", "y").agg(F.max(F.col("run") / F.greatest("n", "m")).alias("ratio"))


def containing(left: DataFrame, right: DataFrame, q: int = 3) -> DataFrame:
    """``(x, y)`` of all texts ``left.s``, of ``q`` letters or more, and texts ``right.s`` that hold them: by the rarest gram of ``x``."""
    texts = lambda df: df.select(F.col("s")).filter("s <> ''").distinct().withColumn("n", F.length("s"))
    a, b = texts(left), texts(right)
    held = _grams(b, q)
    rarity = held.groupBy("g").agg(F.count("*").alias("c"))
    best = _grams(a, q).join(rarity, "g").groupBy("s").agg(F.min_by(F.struct("g", "at"), F.struct("c", "at")).alias("p"))
    met = best.select(F.col("s").alias("x"), "p.g", "p.at").join(held.select("g", F.col("s").alias("y"), F.col("at").alias("j")), "g")
    return met.filter(F.substring(F.col("y"), F.col("j") - F.col("at") + 1, F.length("x")) == F.col("x")).filter("j >= at").select("x", "y").distinct()


# ---------------------------------------------------------------- weighted grams
def top_by_tfidf(queries: DataFrame, corpus: DataFrame, k: int = 5, seeds: int = 3, **fit) -> DataFrame:
    """``(query, text, score, rank)``: for each distinct text ``queries.t`` the ``k`` texts ``corpus.t`` with the greatest TF-IDF cosine, to six digits, equal ones by text.

    Weights are those of :func:`similarity.gram_weights` fitted on the corpus (``fit`` is passed on); a query's own text counts if the corpus holds it. Texts without a shared
    gram are not listed. Queries and texts are cut into blocks of about ``BLOCK``; a task adds up the scores of one block of queries in one of texts, over the lists of texts of each gram, and
    hands on the ``k`` best of each query. So what is shuffled are vectors and best rows, never the pairs; work is all with all. ``seeds`` is taken for callers that name it and decides nothing.
    """
    weights, idf = M.gram_weights(corpus, **fit)
    asked = M.weigh(queries, idf, **{x: fit[x] for x in ("sizes",) if x in fit})
    whole = lambda df, t: df.groupBy(F.col("t").alias(t)).agg(F.collect_list("g").alias("g"), F.collect_list("w").alias("w"))
    parts = lambda df: max(1, -(-df.select("t").distinct().count() // BLOCK))
    n, m = parts(queries), parts(corpus)
    block = lambda t, parts: F.pmod(F.xxhash64(t), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = whole(asked, "q").withColumn("i", block("q", n)).withColumn("j", every(m))
    d = whole(weights, "d").withColumn("j", block("d", m)).withColumn("i", every(n))

    def scored(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("d", ignore_index=True)
        lists: dict[str, tuple[list, list]] = {}
        for at, (gs, ws) in enumerate(zip(d["g"], d["w"])):
            for g, w in zip(gs, ws):
                held = lists.setdefault(g, ([], []))
                held[0].append(at)
                held[1].append(w)
        arrays = {g: (np.array(at, dtype="int32"), np.array(w)) for g, (at, w) in lists.items()}
        asked, texts, scores = [], [], []
        for text, gs, ws in zip(q["q"], q["g"], q["w"]):
            total = np.zeros(len(d))
            for g, w in zip(gs, ws):
                if g in arrays:
                    at, v = arrays[g]
                    total[at] += w * v
            met = np.flatnonzero(total)
            score = np.floor(total[met] * 1e6 + 0.5) / 1e6
            if len(met) > k:
                near = score >= np.partition(score, -k)[-k]
                met, score = met[near], score[near]
            first = np.argsort(-score, kind="stable")[:k]  # texts are in order, so equal scores go by text
            asked += [text] * len(first)
            texts += d["d"].to_numpy()[met[first]].tolist()
            scores += score[first].tolist()
        return pd.DataFrame({"q": asked, "d": texts, "score": scores}).astype({"q": object, "d": object, "score": float})

    best = q.groupBy("i", "j").cogroup(d.groupBy("i", "j")).applyInPandas(scored, "q string, d string, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias("query"), F.col("d").alias("text"), "score", "rank")
