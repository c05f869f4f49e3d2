"""Matching a product with its best offer at each competitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import similarity as M
from . import joins, ranking


def with_images(rows: DataFrame, thresholds: S.Thresholds | None = None) -> DataFrame:
    """Candidates with a name and two images that are similar enough: what can be said before names are compared."""
    t = thresholds or S.Thresholds()
    named = rows.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    return named.filter(F.col("base_image").isNotNull() & F.col("image_path").isNotNull() & (F.col("image_sim") >= t.image_floor))


def passes(scored: DataFrame, source: str, t: S.Thresholds) -> DataFrame:
    """Candidates with a name, enough similarity of text, and two images that are similar enough, with ``combined``."""
    wt, wi = t.weights[source]
    ok = with_images(scored, t).filter(F.col("text_sim") >= t.text_floor[source])
    return ok.withColumn("combined", F.col("text_sim") * wt + F.col("image_sim") * wi)


def best_match(scored: DataFrame, source: str, thresholds: S.Thresholds | None = None, by_hash: bool = True) -> DataFrame:
    """One row for each product that has a match among its offers ``scored``.

    Columns: ``product_id, base_hash, base_image, base_price, ordinal, name, image_path, price, text_sim, image_sim`` and any others. Offers whose image carries
    the product's name hash go before all others. The greatest combined score wins, the first on ties. A match of the shopping
    search also needs a least score, and a better one where its price is far off.
    """
    t = thresholds or S.Thresholds()
    if by_hash:
        scored = joins.hash_or_all(scored, ["product_id"], "base_hash", "image_path")
    top = ranking.best(passes(scored, source, t), ["product_id"], "combined", "ordinal", above=0.0)
    if source == "n":
        far = (F.col("base_price") > 0) & (F.col("price") > 0) & (F.abs(F.col("price") - F.col("base_price")) / F.col("base_price") * 100 > t.n_price_pct)
        top = top.filter(F.col("combined") >= t.n_min).filter(~(F.coalesce(far, F.lit(False)) & (F.col("combined") < t.n_price_score)))
    return top


def match_product(products: DataFrame, k: DataFrame, n: DataFrame) -> DataFrame:
    """``products`` with both best matches, the winner, and its scores and grade.

    The greater combined score wins, a tie goes to ``k``; the site label, though, is ``n`` whenever there is a match there. Without a match at ``n``
    its scores are those of ``k``; without one at ``k`` its scores are 0.
    """
    pick = ["name", "price", "text_sim", "image_sim", "combined"]
    own = lambda df, s: df.select("product_id", *[F.col(c).alias(f"{s}_{c}") for c in pick])
    out = products.join(own(k, "k"), "product_id", "left").join(own(n, "n"), "product_id", "left")
    has_k, has_n = F.col("k_combined").isNotNull(), F.col("n_combined").isNotNull()
    score = F.greatest(F.coalesce("k_combined", F.lit(0.0)), F.coalesce("n_combined", F.lit(0.0)))
    zero = {f"k_{c}": F.coalesce(f"k_{c}", F.lit(0.0)) for c in ("text_sim", "image_sim")}
    borrow = {f"n_{c}": F.coalesce(f"n_{c}", f"k_{c}", F.lit(0.0)) for c in ("text_sim", "image_sim")}
    winner = F.when(has_k & (~has_n | (F.col("k_combined") >= F.col("n_combined"))), "k").when(has_n, "n")
    more = {"winner": winner, "site": F.when(has_n, "n").when(has_k, "k"), "matched": F.when(has_k | has_n, "Y").otherwise("N"), "score": score, "quality": M.quality_label(F.when(has_k | has_n, score)), "n_grade": F.when(has_n, M.grade_label(F.col("n_combined")))}
    return out.withColumns(zero | borrow | more)


def category_thresholds(products: DataFrame, table: DataFrame, default: tuple[float, float] = (0.65, 0.95)) -> DataFrame:
    """``products`` with ``text_min, image_min`` of their category in ``table(category, text_min, image_min)``, else the default."""
    one = table.groupBy("category").agg(F.min(F.struct("text_min", "image_min")).alias("__t"))
    got = products.join(one, "category", "left")
    return got.withColumns({"text_min": F.coalesce("__t.text_min", F.lit(default[0])), "image_min": F.coalesce("__t.image_min", F.lit(default[1]))}).drop("__t")


def match_rate(matched: Column) -> Column:
    """The share of rows with a match."""
    return F.avg(F.when(matched == "Y", 1.0).otherwise(0.0))
