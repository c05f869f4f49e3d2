"""The whole comparison as one lazy plan: products, offers and images in, result and upload rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions import similarity as M
from ..functions import text as T
from ..operators import filters, joins, matching, ranking


def candidates(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products beside their offers, without a text score: by ``product_id``, the product's ``ordinal``, if the offers have it, else by trimmed name.

    ``image_sim`` is taken from the offers if they have it, else it is the constant of a hash match, or 0. What later steps need of the product comes along.
    """
    p = products.select(
        F.col("ordinal").alias("product_id"), "product_name", F.col("base_price").cast("double").alias("base_price"), F.col("base_image"), F.col("base_qty").try_cast("int").alias("base_qty"),
        T.name_hash(F.col("product_name")).alias("base_hash"),
    )
    p = M.with_tokens(p, "product_name", "x")  # once a product, not once a candidate
    if "product_id" in offers.columns:
        both = p.join(offers.drop("product_name"), "product_id")
    else:
        o = offers.withColumnRenamed("product_name", "__for")
        both = p.join(o, F.trim(p["product_name"]) == F.trim(o["__for"])).drop("__for")
    if "image_sim" not in offers.columns:
        both = both.withColumn("image_sim", F.when(T.file_hash(F.col("image_path")) == F.col("base_hash"), 0.95).otherwise(0.0))
    return both


def with_text(rows: DataFrame, model: str | None = None) -> DataFrame:
    """Candidates with their text score. ``model`` names a column with the cosine of the names' embeddings; without it that part is 0."""
    return M.with_text_similarity(rows, "product_name", "name", "text_sim", F.col(model) if model else None)


def scored_offers(products: DataFrame, offers: DataFrame, model: str | None = None) -> DataFrame:
    return with_text(candidates(products, offers), model)


def offer_side(got: DataFrame, source: str, rounding: str) -> DataFrame:
    """The columns of one competitor for each product, of one candidate for each."""
    tiers = F.col("tiers") if "tiers" in got.columns else F.lit(None).cast("map<int,double>")
    at = P.tier(tiers, F.col("base_qty"), "ceil")
    price = P.with_tax(F.coalesce(at["value"], F.col("price").cast("double")), F.col("tax_included") if "tax_included" in got.columns else None)
    got = got.withColumns({"__qty": F.coalesce(at["quantity"], F.col("base_qty")), "__price": price})
    return got.select(
        "product_id", F.col("__qty").alias(f"{source}_qty"), F.col("__price").alias(f"{source}_price"), P.difference(F.col("base_price"), F.col("__price")).alias(f"{source}_diff"),
        P.percent(F.col("base_price"), F.col("__price"), rounding).cast("double").alias(f"{source}_diff_pct"), F.col("link").alias(f"{source}_link"), F.col("supplier").alias(f"{source}_supplier"),
        F.col("image_path").alias(f"{source}_image"), F.col("text_sim").alias(f"{source}_text_sim"), F.col("image_sim").alias(f"{source}_image_sim"),
    )


def compare(products: DataFrame, k: DataFrame, n: DataFrame, offer_policy: str = "best", model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(result, upload)`` rows under our names.

    ``products``: the required columns with ``ordinal`` and ``base_image``. Offers: ``product_name`` or ``product_id``, ``ordinal, name, price, link, supplier, image_path`` and, if they
    have them, ``image_sim``, ``tiers`` (quantity to price) and ``tax_included``. ``offer_policy`` ``best`` shows the best match's offer, ``first`` the first offer of each name.
    Names are compared last: only of offers that have a chance by their images, or of the first ones. Result keeps every product; groups without gain are cleared. Upload holds the
    products that a competitor undercuts.
    """
    out = products
    for s, offers in (("k", k), ("n", n)):
        found = candidates(products, offers)
        if offer_policy == "first":
            top = ranking.best(found.withColumn("__one", F.lit(1.0)), ["product_id"], "__one", "ordinal").drop("__one")
            side = offer_side(with_text(top, model), s, "trunc")
        else:
            likely = matching.with_images(joins.hash_or_all(found, ["product_id"], "base_hash", "image_path"))
            side = offer_side(matching.best_match(with_text(likely, model), s, by_hash=False), s, "even")
        out = out.join(side.withColumnRenamed("product_id", "ordinal"), "ordinal", "left")
    out = filters.clear_unfavourable(out)
    out = filters.clear(out, F.col("n_image").isNull(), filters.N_GROUP)
    result = filters.clear(out, F.col("k_image").isNull(), filters.K_GROUP)
    upload = filters.filter_by_difference(filters.filter_upload(result))
    return result, upload


def undercut(parts: DataFrame, tiers: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Which products a competitor undercuts, by how much: the cheapest supplier of each part at the quantity asked for.

    ``parts(p_partkey, p_name, base_qty, base_price)``; ``tiers(p_partkey, supplier, tier, unit_price)``.
    """
    asked = tiers.select("p_partkey", "supplier").distinct().join(parts, "p_partkey")
    at = joins.tier_offers(asked, tiers, ["p_partkey", "supplier"], "base_qty", "tier", "unit_price", "ceil")
    price = P.with_tax(F.col("tier_price"))
    rows = at.withColumns({"price": price, "diff": P.difference(F.col("base_price"), price), "diff_pct": P.percent(F.col("base_price"), price, "trunc")}).filter(F.col("diff") < threshold)
    best = rows.groupBy("p_partkey").agg(F.min_by(F.struct("p_name", "base_qty", "base_price", "supplier", "tier_qty", "exact", "price", "diff", "diff_pct"), F.struct("price", "supplier")).alias("b"))
    return best.select("p_partkey", "b.*")
