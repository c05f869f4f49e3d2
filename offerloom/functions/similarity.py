"""Similarities between names, vectors and images, and the labels given to scores.

All but two are column expressions. The block-matching ratio and the longest common substring have no built-in form; they run as
Arrow UDFs, and callers apply them after the cheap filters.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def common_tokens(a: Column, b: Column) -> Column:
    """How many distinct name tokens two names share."""
    return F.size(F.array_intersect(T.name_tokens(a), T.name_tokens(b)))


def token_similarity(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity and half the coverage of two token lists, the longer list's coverage weighing 0.7."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    n, m = F.size(a), F.size(b)
    one, two = shared / n, shared / m
    coverage = F.when(n > m, F.lit(0.7) * one + F.lit(0.3) * two).otherwise(F.lit(0.3) * one + F.lit(0.7) * two)
    return F.when((n > 0) & (m > 0), F.lit(0.5) * (shared / F.size(F.array_union(a, b))) + F.lit(0.5) * coverage).otherwise(0.0)


def number_score(a: Column, b: Column) -> Column:
    """Jaccard similarity of the digit runs of two texts; 0.5 if neither has any, 0 if one has none."""
    x, y = T.numbers(a), T.numbers(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 0.5).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of two texts that lies in matching blocks (Ratcliff and Obershelp); not symmetric; 0 if one is empty."""
    matcher, out, last = SequenceMatcher(None), [], None
    for x, y in zip(a, b):
        if not x or not y:
            out.append(0.0)
            continue
        if y != last:  # what is known of the second text is kept for the next pair
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


#: The same for scores that are filtered later: Spark moves no filter below it, which would have the whole score, and each part of it again, worked out for the filter too
ratio_once = F.pandas_udf(fuzzy_ratio.func, DoubleType()).asNondeterministic()


@F.pandas_udf(DoubleType())
def substring_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest common substring over the longer length; 0 if one is empty."""
    out = []
    for x, y in zip(a, b):
        if not x or not y:
            out.append(0.0)
        else:
            m = SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
            out.append(m.size / max(len(x), len(y)))
    return pd.Series(out, dtype=float)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one is null, zero, or of another length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def ensemble(primary: Column, *extra: Column, weight: float = 0.6) -> Column:
    """The primary model's cosine by ``weight``, the others' sharing the rest; alone it counts in full."""
    if not extra:
        return primary
    out = primary * weight
    for c in extra:
        out = out + c * ((1 - weight) / len(extra))
    return out


def deep(primary: Column, *extra: Column) -> Column:
    """Each further model, in order, takes three tenths of the score."""
    for c in extra:
        primary = primary * 0.7 + c * 0.3
    return primary


#: The parts of the text score
TEXT_WEIGHTS = {"model": 0.55, "token": 0.20, "fuzzy": 0.10, "tfidf": 0.10, "number": 0.05}


def text_similarity(a: Column, b: Column, model: Column, tfidf: Column | None = None, fuzzy: Column | None = None) -> Column:
    """The mix of model, token, fuzzy, n-gram and number scores of two names.

    0 if one is blank, 1 if both clean to the same text. ``model`` is the cosine of their embeddings; ``tfidf`` is 0 unless given.
    """
    x, y = T.clean_text(a), T.clean_text(b)
    w = TEXT_WEIGHTS
    parts = model * w["model"] + token_similarity(T.name_tokens(x), T.name_tokens(y)) * w["token"]
    parts = parts + (fuzzy_ratio(x, y) if fuzzy is None else fuzzy) * w["fuzzy"] + (F.lit(0.0) if tfidf is None else tfidf) * w["tfidf"] + number_score(x, y) * w["number"]
    blank = F.coalesce(F.trim(a) == "", F.lit(True)) | F.coalesce(F.trim(b) == "", F.lit(True))
    return F.when(blank, 0.0).when(x == y, 1.0).otherwise(parts)


def with_tokens(df: DataFrame, name: str, side: str) -> DataFrame:
    """``df`` with a name's cleaned text ``__<side>`` and its tokens ``__t<side>``. What is clean without brackets stays as it is when cleaned again."""
    out = df.withColumn(f"__{side}", T.clean_text(F.col(name)))
    clean = F.col(f"__{side}")
    return out.withColumn(f"__t{side}", F.when(F.coalesce(F.col(name).contains("("), F.lit(False)), T.name_tokens(clean)).otherwise(T.split_words(T.words(clean))))


def with_text_similarity(df: DataFrame, a: str, b: str, out: str, model: Column | None = None, tfidf: Column | None = None) -> DataFrame:
    """``df`` with :func:`text_similarity` of two columns as ``out``, its parts staged so that each name is cleaned and cut once a row.

    Names that clean to the same text are not handed to Python. Of names that stand beside many others, :func:`with_tokens` may be asked for beforehand, as side ``x``.
    """
    staged = df if "__tx" in df.columns else with_tokens(df, a, "x")
    staged = with_tokens(staged, b, "y")
    differ = F.col("__x") != F.col("__y")
    staged = staged.withColumns({"__t": token_similarity(F.col("__tx"), F.col("__ty")), "__n": number_score(F.col("__x"), F.col("__y")), "__f": ratio_once(F.when(differ, F.col("__x")), F.when(differ, F.col("__y")))})
    w = TEXT_WEIGHTS
    parts = (F.lit(0.0) if model is None else model) * w["model"] + F.col("__t") * w["token"]
    parts = parts + F.col("__f") * w["fuzzy"] + (F.lit(0.0) if tfidf is None else tfidf) * w["tfidf"] + F.col("__n") * w["number"]
    blank = F.coalesce(F.trim(a) == "", F.lit(True)) | F.coalesce(F.trim(b) == "", F.lit(True))
    return staged.withColumn(out, F.when(blank, 0.0).when(~differ, 1.0).otherwise(parts)).drop("__x", "__y", "__tx", "__ty", "__t", "__n", "__f")


def fallback_text_similarity(model: Column, a: Column, b: Column) -> Column:
    """Seven tenths of the model's cosine and three of the shared words over the larger set, between 0 and 1."""
    x, y = F.array_distinct(T.words(F.lower(a))), F.array_distinct(T.words(F.lower(b)))
    largest = F.greatest(F.size(x), F.size(y))
    overlap = F.when(largest > 0, F.size(F.array_intersect(x, y)) / largest).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), model * 0.7 + overlap * 0.3))


def with_exact_bonus(score: Column, exact: Column, bonus: float = 0.25) -> Column:
    return F.least(F.lit(1.0), score + F.when(exact, bonus).otherwise(0.0))


def legacy_token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity, a tenth more for each shared token of four characters or more, 1 at most."""
    long_ = F.size(F.filter(F.array_intersect(a, b), lambda x: F.length(x) >= 4))
    return F.least(F.lit(1.0), jaccard(a, b) * (F.lit(1.0) + F.lit(0.1) * long_))


#: What each image method weighs
IMAGE_WEIGHTS = {"sift": 0.40, "akaze": 0.30, "deep": 0.20, "orb": 0.10}


def image_score(sift: Column, akaze: Column, deep_: Column, orb: Column, has_deep: bool = True) -> Column:
    """One score from those of four image methods.

    The weighted mean is lifted to a share of the best score by how many methods are high (0.6 or more), medium (0.3) or low (0.1),
    by 15 % where both keypoint methods reach 0.4, and by up to 10 % as the scores above 0.01 agree. Without a deep model its weight
    goes to the others, each in turn by its share of the weights as they then stand.
    """
    w = dict(IMAGE_WEIGHTS)
    if not has_deep:
        rest, deep_ = w.pop("deep"), F.lit(0.0)
        for k in w:
            w[k] += rest * (w[k] / sum(w.values()))
    own = {"sift": sift, "akaze": akaze, "deep": deep_, "orb": orb}
    s = {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in own.items()}
    total = sum((s[k] * w[k] for k in w), F.lit(0.0)) / sum(w.values())

    def in_tier(low: float, high: float = 9.0) -> Column:
        return sum((F.when((c >= low) & (c < high), 1).otherwise(0) for c in s.values()), F.lit(0))

    high, medium, low = in_tier(0.6), in_tier(0.3, 0.6), in_tier(0.1, 0.3)
    best = F.greatest(*s.values())
    share = F.when(high >= 2, 0.8).when((high == 1) & (medium >= 1), 0.7).when(medium >= 2, 0.6).when((medium == 1) & (low >= 1), 0.5).when((high == 0) & (low >= 2), 0.3).when((high >= 1) & (low >= 2), 0.3).otherwise(0.0)
    total = F.greatest(total, best * share)
    total = F.when((s["sift"] >= 0.4) & (s["akaze"] >= 0.4), F.least(F.lit(1.0), total * 1.15)).otherwise(total)
    some = F.filter(F.array(*s.values()), lambda x: x > 0.01)
    n = F.size(some)
    mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(some, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    boost = F.least(F.lit(0.1), F.greatest(F.lit(0.0), 1 - spread) * 0.2)
    return F.when(n >= 2, F.least(F.lit(1.0), total * (1 + boost))).otherwise(total)


def image_similarity(path_a: Column, path_b: Column, score: Column) -> Column:
    """1 for one and the same file, 0 if one is missing, else the score."""
    return F.when(path_a.isNull() | path_b.isNull(), 0.0).when(path_a == path_b, 1.0).otherwise(score)


def keypoint_score(good: Column, inliers: Column, keypoints_a: Column, keypoints_b: Column) -> Column:
    """The score of a keypoint method from its counts: good matches over the fewer keypoints, with the share of inliers if five or more fit."""
    fewer = F.least(keypoints_a, keypoints_b)
    ratio = F.when(fewer > 0, good / fewer).otherwise(0.0)
    mixed = F.when((good >= 5) & inliers.isNotNull(), ratio * 0.6 + (inliers / good) * 0.4).otherwise(ratio)
    return F.least(F.lit(1.0), mixed * 2)


def geometric_match(inliers: Column, good: Column, least: int) -> Column:
    """Enough inliers, or more than half of the good matches."""
    return (inliers > least) | F.coalesce(F.try_divide(inliers.cast("double"), good) > 0.5, F.lit(False))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.6, "High").when(score >= 0.3, "Medium").when(score >= 0.1, "Low").otherwise("Very Low")


def grade_label(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.6, "mid").otherwise("low")


def quality_label(score: Column, high: float = 0.95, medium: float = 0.70, low: float = 0.50, reject: float = 0.50) -> Column:
    """``none`` for a null score; the label of the first limit it reaches, else ``rejected``."""
    return F.when(score.isNull(), "none").when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").when(score >= reject, "questionable").otherwise("rejected")


def char_grams(c: Column, sizes: tuple[int, int] = (2, 4)) -> Column:
    """Runs of ``sizes`` letters, in lower case, within words padded by blanks, repeats included."""

    def runs(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) + 1 - n)
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def per_word(w: Column) -> Column:
        return F.flatten(F.array(*[runs(F.concat(F.lit(" "), w, F.lit(" ")), n) for n in range(sizes[0], sizes[1] + 1)]))

    return F.flatten(F.transform(T.words(F.lower(c)), per_word))


def weigh(texts: DataFrame, idf: DataFrame, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """``(t, g, w)``: the grams of each distinct text ``t`` that ``idf(g, idf)`` holds, by ``1 + ln tf`` times their idf, at length 1."""
    counts = texts.select("t").filter("t is not null").distinct().select("t", F.explode(char_grams(F.col("t"), sizes)).alias("g")).groupBy("t", "g").count()
    weights = counts.join(idf, "g").select("t", "g", ((1 + F.log("count")) * F.col("idf")).alias("w"))
    length = weights.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return weights.join(length, "t").select("t", "g", (F.col("w") / F.col("l")).alias("w"))


def gram_weights(texts: DataFrame, min_df: int = 2, max_df: float = 0.9, sizes: tuple[int, int] = (2, 4)) -> tuple[DataFrame, DataFrame]:
    """:func:`weigh` of the distinct texts ``t``, and the ``idf(g, idf)`` that it uses: ``ln((1 + n) / (1 + df)) + 1`` over them.

    Grams in fewer than ``min_df`` texts or more than ``max_df`` of them don't count. With ten texts or fewer nothing is fitted.
    """
    own = texts.select("t").filter("t is not null").distinct()
    total = own.agg(F.count("*").alias("n"))
    df = own.select("t", F.explode(F.array_distinct(char_grams(F.col("t"), sizes))).alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(total)).filter((F.col("n") > 10) & (F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    idf = idf.select("g", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    return weigh(own, idf, sizes), idf


def tfidf_cosine(pairs: DataFrame, left: str, right: str, min_df: int = 2, max_df: float = 0.9, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """``pairs`` with ``tfidf``: the cosine of the character n-gram weights of two texts, within words padded by blanks.

    Weights are those of :func:`gram_weights` over the distinct texts of both sides; with ten texts or fewer the score is 0.
    """
    texts = pairs.select(F.col(left).alias("t")).union(pairs.select(right))
    unit, _ = gram_weights(texts, min_df, max_df, sizes)
    wanted = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct()
    scored = wanted.join(unit.toDF("a", "g", "wa"), "a").join(unit.toDF("b", "g", "wb"), ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    out = pairs.join(scored, (pairs[left] == scored["a"]) & (pairs[right] == scored["b"]), "left")
    return out.select(*[pairs[c] for c in pairs.columns], F.coalesce("s", F.lit(0.0)).alias("tfidf"))
