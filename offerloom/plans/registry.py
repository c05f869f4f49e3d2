"""Named queries over the driver's tables and the SQL that must give the same rows.

``part`` is the catalogue; a line item is an offer of its supplier: its quantity is the tier, its price over its quantity the
unit price. Suppliers with an even key stand for the promotional competitor ``k``, the others for the shopping search ``n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import pricing as P
from ..functions import similarity as M
from ..functions import text as T
from ..operators import aggregates, filters, joins, matching, ranking, similar
from ..sources import html_tables
from ..streaming import offers as streams
from . import compare

FLAGSHIP = "undercut_products"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many even partitions as a shuffle has: a small file is one task, however much is to be done for each of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.col("p_size").alias("base_qty"), F.col("p_retailprice").alias("base_price"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    return item.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("int").alias("tier"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


TIERS = "tiers AS (SELECT l_partkey AS p_partkey, l_suppkey AS supplier, l_quantity::INT AS tier, l_extendedprice / l_quantity AS unit_price FROM lineitem WHERE l_quantity > 0)"


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the cheapest unit price of both competitors, tax added, and what it differs from the part's own."""
    t = tiers(spark, sf_dir).withColumn("source", F.when(F.col("supplier") % 2 == 0, "k").otherwise("n"))
    best = t.groupBy("p_partkey", "source").agg(F.min_by(F.struct("supplier", "tier", "unit_price"), F.struct("unit_price", "supplier", "tier")).alias("b"))
    sides = best.groupBy("p_partkey").agg(*[F.max(F.when(F.col("source") == s, F.col("b"))).alias(s) for s in "kn"])
    out = parts(spark, sf_dir).join(sides, "p_partkey", "left")
    for s in "kn":
        price = P.with_tax(F.col(f"{s}.unit_price"))
        out = out.withColumns({
            f"{s}_qty": F.col(f"{s}.tier"), f"{s}_price": price, f"{s}_diff": P.difference(F.col("base_price"), price), f"{s}_diff_pct": P.percent(F.col("base_price"), price, "trunc"),
            f"{s}_link": F.concat(F.lit("https://shop.example/"), F.col(f"{s}.supplier").cast("string")),
        })
    return out.drop("k", "n", "p_name", "p_type")


def _side(s: str) -> str:
    price = f"round_even({s}.unit_price * 1.1, 0)"
    return f"{s}.tier AS {s}_qty, {price} AS {s}_price, {price} - p_retailprice AS {s}_diff, trunc(({price} - p_retailprice) / p_retailprice * 100)::INT AS {s}_diff_pct, 'https://shop.example/' || {s}.supplier AS {s}_link"


def _cheapest(s: str, rest: int) -> str:
    return f"{s} AS (SELECT * FROM tiers WHERE supplier % 2 = {rest} QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY unit_price, supplier, tier) = 1)"


COMPARISON = f"{TIERS}, {_cheapest('k', 0)}, {_cheapest('n', 1)}, c AS (SELECT p.p_partkey, p_size AS base_qty, p_retailprice AS base_price, {_side('k')}, {_side('n')} FROM part p LEFT JOIN k ON k.p_partkey = p.p_partkey LEFT JOIN n ON n.p_partkey = p.p_partkey)"


def at_tier(mode: str) -> str:
    """SQL for the tier that holds for each part's quantity at each of its suppliers."""
    near, end = (">=", "max") if mode == "ceil" else ("<=", "min")
    pick = "min" if mode == "ceil" else "max"
    return (
        f"{TIERS}, t AS (SELECT p_partkey, supplier, tier, min(unit_price) AS unit_price FROM tiers GROUP BY ALL), "
        f"q AS (SELECT p_partkey, supplier, p_name, p_size AS base_qty, p_retailprice AS base_price, coalesce({pick}(tier) FILTER (tier {near} p_size), {end}(tier)) AS tier FROM t JOIN part USING (p_partkey) GROUP BY ALL), "
        "a AS (SELECT q.*, t.unit_price, q.tier = base_qty AS exact FROM q JOIN t USING (p_partkey, supplier, tier))"
    )


@query(
    f"WITH {at_tier('ceil')}, r AS (SELECT p_partkey, p_name, base_qty, base_price, supplier, tier AS tier_qty, exact, round_even(unit_price * 1.1, 0) AS price FROM a) "
    "SELECT *, price - base_price AS diff, trunc((price - base_price) / base_price * 100)::INT AS diff_pct FROM r WHERE price - base_price < -1 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY price, supplier) = 1"
)
def undercut_products(spark, sf_dir):
    return compare.undercut(parts(spark, sf_dir), tiers(spark, sf_dir))


def _tier_rows(spark, sf_dir, mode):
    asked = tiers(spark, sf_dir).select("p_partkey", "supplier").distinct().join(parts(spark, sf_dir), "p_partkey")
    return joins.tier_offers(asked, tiers(spark, sf_dir), ["p_partkey", "supplier"], "base_qty", "tier", "unit_price", mode).select("p_partkey", "supplier", "base_qty", "tier_qty", "tier_price", "exact")


@query(f"WITH {at_tier('ceil')} SELECT p_partkey, supplier, base_qty, tier AS tier_qty, unit_price AS tier_price, exact FROM a")
def tier_ceil(spark, sf_dir):
    return _tier_rows(spark, sf_dir, "ceil")


@query(f"WITH {at_tier('floor')} SELECT p_partkey, supplier, base_qty, tier AS tier_qty, unit_price AS tier_price, exact FROM a")
def tier_floor(spark, sf_dir):
    return _tier_rows(spark, sf_dir, "floor")


@query("SELECT l_partkey AS p_partkey, l_suppkey AS supplier, min(l_quantity::INT) AS min_qty, max(l_quantity::INT) AS max_qty, count(DISTINCT l_quantity::INT) AS n_tiers FROM lineitem WHERE l_quantity > 0 GROUP BY ALL")
def tier_bounds(spark, sf_dir):
    return aggregates.tier_bounds(tiers(spark, sf_dir), ["p_partkey", "supplier"], "tier")


@query("SELECT DISTINCT l_quantity::INT::BIGINT AS quantity FROM lineitem WHERE l_quantity > 0")
def distinct_quantities(spark, sf_dir):
    return aggregates.distinct_quantities(tiers(spark, sf_dir), "tier")


@query(f"WITH {COMPARISON} SELECT * FROM c")
def price_comparison(spark, sf_dir):
    return comparison(spark, sf_dir)


@query(
    "SELECT p_partkey, round_even(p_retailprice * 1.1, 0) AS taxed, p_retailprice * 1.1 AS taxed_unrounded, trunc((p_size * 10.0::DOUBLE - p_retailprice) / p_retailprice * 100)::INT AS pct_trunc, "
    "round_even((p_size * 10.0::DOUBLE - p_retailprice) / p_retailprice * 100, 0)::INT AS pct_even FROM part"
)
def tax_and_percent(spark, sf_dir):
    base, other = F.col("p_retailprice"), F.col("p_size") * F.lit(10.0)
    return table(spark, sf_dir, "part").select("p_partkey", P.with_tax(base).alias("taxed"), P.with_tax_unrounded(base).alias("taxed_unrounded"), P.percent(base, other, "trunc").alias("pct_trunc"), P.percent(base, other, "even").alias("pct_even"))


def _cleared(s: str) -> str:
    return ", ".join(f"CASE WHEN NOT coalesce({s}_diff >= 0 OR {s}_diff_pct > -1, false) THEN {s}_{c} END AS {s}_{c}" for c in ("qty", "price", "diff", "diff_pct", "link"))


CLEARED = f"{COMPARISON}, u AS (SELECT p_partkey, base_qty, base_price, {_cleared('k')}, {_cleared('n')} FROM c)"


def _cast(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in ("k_diff_pct", "n_diff_pct")})


@query(f"WITH {CLEARED} SELECT * FROM u")
def clear_unfavourable(spark, sf_dir):
    return _cast(filters.clear_unfavourable(comparison(spark, sf_dir)))


@query(f"WITH {COMPARISON} SELECT * FROM c WHERE coalesce(k_diff < -1, false) OR coalesce(n_diff < -1, false)")
def filter_upload(spark, sf_dir):
    return filters.filter_upload(comparison(spark, sf_dir))


@query(f"WITH {COMPARISON} SELECT * FROM c WHERE (k_diff IS NULL OR k_diff < -1) AND (n_diff IS NULL OR n_diff < -1)")
def filter_by_difference(spark, sf_dir):
    return filters.filter_by_difference(comparison(spark, sf_dir))


@query(f"WITH {CLEARED} SELECT * FROM u WHERE (k_diff < -1 OR n_diff < -1) AND (k_diff IS NULL OR k_diff < -1) AND (n_diff IS NULL OR n_diff < -1)")
def upload_table(spark, sf_dir):
    return _cast(filters.filter_by_difference(filters.filter_upload(filters.clear_unfavourable(comparison(spark, sf_dir)))))


@query(f"WITH {COMPARISON} SELECT p_partkey, coalesce(k_diff < -1, false) OR coalesce(n_diff < -1, false) OR coalesce(k_diff_pct < -1, false) OR coalesce(n_diff_pct < -1, false) AS highlight FROM c")
def highlight(spark, sf_dir):
    return filters.highlight(comparison(spark, sf_dir)).select("p_partkey", "highlight")


@query(f"WITH {COMPARISON} SELECT p_partkey, k_diff, n_diff FROM c WHERE coalesce(k_diff < 0, false) OR coalesce(n_diff < 0 AND NOT coalesce(n_qty IS NULL AND abs(n_diff_pct) <= 10, false), false)")
def business_rows(spark, sf_dir):
    c = comparison(spark, sf_dir).withColumns({"k_was": F.col("k_diff"), "n_was": F.col("n_diff")})
    return filters.business_rules(c).select("p_partkey", F.col("k_was").alias("k_diff"), F.col("n_was").alias("n_diff"))


@query(f"WITH {COMPARISON} SELECT count(k_price) AS k_price, count(n_price) AS n_price, count(base_price) AS base_price FROM c")
def valid_counts(spark, sf_dir):
    return aggregates.valid_counts(comparison(spark, sf_dir), ["k_price", "n_price", "base_price"])


@query("SELECT p_partkey, substr(md5(regexp_replace(lower(regexp_replace(p_name, '\\s+', '', 'g')), '[^\\p{L}\\p{N}_]+', '', 'g')), 1, 16) AS name_hash FROM part")
def name_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.name_hash(F.col("p_name")).alias("name_hash"))


#: names that share a word, each pair both ways
PAIRS = "names AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), tokens AS (SELECT name, w, unnest(w) AS t FROM names), pairs AS (SELECT DISTINCT a.name AS a, b.name AS b, a.w AS x, b.w AS y FROM tokens a JOIN tokens b USING (t))"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names have two words, so sharing one is half of the larger set."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("t", F.array_distinct(T.name_tokens(F.col("name"))))
    one = similar.overlapping(names, "name", "t", 0.5).select("a", "b")
    return one.union(one.select("b", "a")).union(names.select("name", "name"))


@query(
    f"WITH {PAIRS}, s AS (SELECT a, b, len(list_intersect(x, y))::DOUBLE AS shared, len(x) AS n, len(y) AS m, len(list_distinct(list_concat(x, y))) AS u FROM pairs) "
    "SELECT a, b, shared / u AS jaccard, round(0.5 * (shared / u) + 0.5 * (CASE WHEN n > m THEN 0.7 * shared / n + 0.3 * shared / m ELSE 0.3 * shared / n + 0.7 * shared / m END), 6) AS token_sim FROM s"
)
def token_similarity(spark, sf_dir):
    x, y = T.name_tokens(F.col("a")), T.name_tokens(F.col("b"))
    return name_pairs(spark, sf_dir).select("a", "b", M.jaccard(x, y).alias("jaccard"), F.round(M.token_similarity(x, y), 6).alias("token_sim"))


def block_sql(x: str, y: str) -> str:
    """SQL for the longest common block of two texts, the first in ``x`` of equal ones and there the first in ``y``: its length, and where it starts; null if there is none."""
    held = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: list_filter(list_transform(range(1, length({x}) - i + 2), lambda k: {{'k': k, 'i': -i}}), lambda s: contains({y}, substr({x}, -s.i, s.k)))))"
    return f"list_sort({held})[-1]"


#: the matching blocks of all pairs ``w(a, b)``, each cut out before what stands on both sides of it is searched
BLOCKS = (
    f"rest AS (SELECT a, b, a AS x, b AS y, {block_sql('a', 'b')} AS m FROM w UNION ALL SELECT a, b, c.x, c.y, {block_sql('c.x', 'c.y')} FROM (SELECT a, b, unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, strpos(y, substr(x, -m.i, m.k)) - 1)}}, "
    "{'x': substr(x, -m.i + m.k), 'y': substr(y, strpos(y, substr(x, -m.i, m.k)) + m.k)}]) AS c FROM rest WHERE m IS NOT NULL) WHERE c.x <> '' AND c.y <> ''), "
    "ratios AS (SELECT a, b, 2.0::DOUBLE * coalesce(sum(m.k), 0) / (length(a) + length(b)) AS ratio FROM rest GROUP BY a, b)"
)


@query(f"WITH RECURSIVE {PAIRS}, w AS (SELECT a, b FROM pairs), {BLOCKS} SELECT * FROM ratios")
def fuzzy_ratio(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a", "b", M.fuzzy_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(
    "WITH m AS (SELECT label, min(vec_id) AS main_id FROM embeddings GROUP BY label), t AS (SELECT m.label, main_id, embedding::DOUBLE[] AS main FROM m JOIN embeddings e ON e.vec_id = main_id AND e.label = m.label) "
    "SELECT vec_id, main_id, round(list_dot_product(embedding::DOUBLE[], main) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(main, main))), 6) AS score FROM embeddings JOIN t USING (label)"
)
def best_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mains = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return joins.best_vector(e, mains, ["label"]).withColumn("score", F.round("score", 6))


@query(
    f"WITH {TIERS}, s AS (SELECT p_partkey, tier, unit_price, supplier, p_retailprice, least(unit_price, p_retailprice) / greatest(unit_price, p_retailprice) AS score FROM tiers JOIN part USING (p_partkey)), "
    "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, supplier * 100 + tier) = 1) "
    "SELECT p_partkey, supplier, tier, score, CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'rejected' END AS quality, CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'mid' ELSE 'low' END AS grade, "
    "CASE WHEN score >= 0.6 THEN 'High' WHEN score >= 0.3 THEN 'Medium' WHEN score >= 0.1 THEN 'Low' ELSE 'Very Low' END AS confidence FROM b"
)
def best_offer(spark, sf_dir):
    s = tiers(spark, sf_dir).join(parts(spark, sf_dir), "p_partkey")
    s = s.select("p_partkey", "supplier", "tier", (F.least("unit_price", "base_price") / F.greatest("unit_price", "base_price")).alias("score"), (F.col("supplier") * 100 + F.col("tier")).alias("ordinal"))
    x = F.col("score")
    return ranking.best(s, ["p_partkey"], "score", "ordinal").select("p_partkey", "supplier", "tier", "score", M.quality_label(x).alias("quality"), M.grade_label(x).alias("grade"), M.confidence_label(x).alias("confidence"))


@query(
    "SELECT l_partkey AS p_partkey, l_suppkey * 100 + l_quantity::INT AS offer FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity::INT AS l_quantity FROM lineitem WHERE l_quantity > 0) "
    "QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey * 100 + l_quantity) <= 5"
)
def first_offers(spark, sf_dir):
    o = tiers(spark, sf_dir).select("p_partkey", (F.col("supplier") * 100 + F.col("tier")).alias("offer")).distinct()
    return ranking.first_rows(o, ["p_partkey"], "offer", 5)


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def drop_repeats(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name", "p_partkey", F.col("p_partkey").alias("ordinal"))
    return ranking.drop_repeats(p, ["p_name"], "ordinal").drop("ordinal")


@query("WITH n AS (SELECT p_type, p_name, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL) SELECT p_type, p_name, n FROM n QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, f) = 1")
def most_results(spark, sf_dir):
    return ranking.most_results(table(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey")


@query("SELECT floor(p_partkey / 100)::BIGINT AS batch, count(*) AS n FROM part GROUP BY ALL")
def batches(spark, sf_dir):
    return aggregates.counts_by(table(spark, sf_dir, "part").withColumn("batch", ranking.batches(F.col("p_partkey"))), "batch")


@query("SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS joined FROM part GROUP BY p_type")
def joined_set(spark, sf_dir):
    return aggregates.joined_set(table(spark, sf_dir, "part"), ["p_type"], "p_brand")


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS text_min FROM part")
def category_thresholds(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("category", F.when(F.col("p_size") > 25, "large").otherwise("small"))
    t = spark.createDataFrame([("large", 0.8, 0.9)], "category string, text_min double, image_min double")
    return matching.category_thresholds(p, t).select("p_partkey", "p_name", "text_min")


@query("SELECT s_suppkey, n_name, coalesce(r_name, n_name) AS place FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def lookups(spark, sf_dir):
    """A lookup by one column, else by another: here region by key, else the nation's name."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("place"))
    got = joins.lookup_twice(s, r, "n_regionkey", "n_name", "key", "place")
    return got.select("s_suppkey", "n_name", F.coalesce("place", "n_name").alias("place"))


@query("SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, coalesce(regexp_matches(url, '^https?://'), false) AS http FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.url_host(u).alias("host"), T.url_path(u).alias("path"), T.is_http(u).alias("http"))


@query("SELECT page_id, md5(trim(regexp_replace(html, '<[^\\n]*?>', '', 'g'), ' ')) AS bare FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("bare"))


@query()
def price_tables(spark, sf_dir):
    """Nested tables need a parser; the tests hold it against written pages."""
    got = html_tables.price_tables(table(spark, sf_dir, "pages"))
    return got.select("page_id", F.size("tiers").alias("n_tiers"), "tax_excluded", "detector")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    got = streams.windowed(table(spark, sf_dir, "events"))
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "WITH s AS (SELECT event_id, event_type, value FROM events), m AS (SELECT event_type, count(*) AS n, count(*) FILTER (value >= 100) AS hits FROM s GROUP BY ALL) SELECT event_type, n, hits FROM m"
)
def hits_by_type(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = aggregates.counts_by(e, "event_type")
    hits = aggregates.counts_by(e.filter("value >= 100"), "event_type").withColumnRenamed("n", "hits")
    return joins.combine_matches(n, hits, hits.select("event_type"), key="event_type").withColumn("hits", F.coalesce("hits", F.lit(0)))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%bolt%' THEN true ELSE false END AS found, lower(p_brand) AS brand FROM part")
def keyword_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.contains_any(F.col("p_name"), ("widget", "bolt")).alias("found"), F.lower("p_brand").alias("brand"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g')::BIGINT AS number, try_cast(p_brand AS DOUBLE) IS NULL AS no_number FROM part")
def numbers_in_text(spark, sf_dir):
    b = F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.digits_or_zero(b).alias("number"), N.to_number(b).isNull().alias("no_number"))
