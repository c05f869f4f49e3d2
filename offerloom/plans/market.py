"""More named queries: matching, image joins, text rules, and the comparison from end to end, each with its SQL.

The driver's tables hold no shop data, so cells are made of their columns by expressions that Spark and DuckDB read alike: the constants
below. What is made of them goes through the library's operators on one side and through written-out SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import pricing as P
from ..functions import similarity as M
from ..functions import text as T
from ..operators import aggregates, filters, images, joins, matching, ranking
from . import compare
from .registry import BLOCKS, query, table


def hash_sql(name: str) -> str:
    bare = rf"regexp_replace(lower(regexp_replace(coalesce({name}, ''), '\s+', '', 'g')), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
    return f"CASE WHEN {bare} = '' THEN '' ELSE substr(md5({bare}), 1, 16) END"


def stem_sql(path: str) -> str:
    return rf"regexp_replace(regexp_extract({path}, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"


def file_hash_sql(path: str) -> str:
    stem, hexes = stem_sql(path), "'^[0-9a-fA-F]{16}$'"
    return f"CASE WHEN regexp_matches(split_part({stem}, '_', 2), {hexes}) THEN lower(split_part({stem}, '_', 2)) WHEN regexp_matches({stem}, {hexes}) THEN lower({stem}) END"


# ---------------------------------------------------------------- names and keywords
NAME = (
    "CASE p_partkey % 8 WHEN 0 THEN p_name || ' (' || p_brand || ')' WHEN 1 THEN '777 쓰리쎄븐 TS-' || p_size || 'C ' || p_name WHEN 2 THEN '  ' || upper(p_name) || '  ' WHEN 3 THEN '!!!' "
    "WHEN 4 THEN NULL WHEN 5 THEN p_size || '개입 ' || p_name || ' 신상_v2' WHEN 6 THEN p_name || '[' || p_size || 'x' || p_partkey || ']-세트 (대) {중}' ELSE 'AB-' || p_partkey || ' ' || p_type || ' 컵' END"
)
PATH = "CASE p_partkey % 5 WHEN 0 THEN 'dir/k_' || substr(md5(p_name), 1, 16) || '_12345678.JPG' WHEN 1 THEN upper(substr(md5(p_name), 1, 16)) || '.png' WHEN 2 THEN 'x/naver_invalidhash.jpg' WHEN 3 THEN 'k_' || substr(md5(p_brand), 1, 16) || '.tar.gz' END"
NAMED = f"named AS (SELECT p_partkey, {NAME} AS name, {PATH} AS path FROM part)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{NAME} AS name", f"{PATH} AS path")


@query(
    f"WITH {NAMED} SELECT p_partkey, {hash_sql('name')} AS name_hash, 'k_' || CASE WHEN {hash_sql('name')} = '' THEN substr(md5(coalesce(name, '')), 1, 16) ELSE {hash_sql('name')} END || '.jpg' AS file_name, "
    f"{stem_sql('path')} AS stem, {file_hash_sql('path')} AS file_hash, trim(translate(name, '()[]{{}}', '')) AS bare, trim(split_part(name, '(', 1)) AS base, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS squeezed FROM named"
)
def file_names(spark, sf_dir):
    n, p = F.col("name"), F.col("path")
    return named(spark, sf_dir).select(
        "p_partkey", T.name_hash(n).alias("name_hash"), T.file_name(n, F.lit("k"), F.lit("jpg")).alias("file_name"), T.file_stem(p).alias("stem"), T.file_hash(p).alias("file_hash"),
        T.without_brackets(n).alias("bare"), T.base_keyword(n).alias("base"), T.squeeze(n).alias("squeezed"),
    )


def clean_sql(name: str) -> str:
    low = f"lower(coalesce({name}, ''))"
    outside = rf"trim(regexp_replace(regexp_replace(regexp_replace({low}, '\([^)]*\)', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    inside = rf"array_to_string(regexp_extract_all({low}, '\(([^)]*)\)', 1), ' ')"
    return rf"CASE WHEN regexp_matches({low}, '\([^)]*\)') THEN {outside} || ' ' || {inside} ELSE {outside} END"


def tokens_sql(name: str) -> str:
    return (
        rf"flatten(list_transform(list_filter(string_split_regex({clean_sql(name)}, '\s+'), lambda x: x <> ''), lambda t: CASE WHEN regexp_matches(t, '^\d+[a-z가-힣]+') "
        r"THEN [regexp_extract(t, '^(\d+)([a-z가-힣]+)', 1), regexp_extract(t, '^(\d+)([a-z가-힣]+)', 2)] ELSE [t] END))"
    )


@query(
    rf"WITH {NAMED} SELECT p_partkey, {clean_sql('name')} AS clean, array_to_string({tokens_sql('name')}, '|') AS tokens, array_to_string(regexp_extract_all(coalesce(name, ''), '\d+'), '|') AS numbers, "
    r"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(name, ''), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+'), lambda x: x <> ''))), '|') AS words FROM named"
)
def clean_names(spark, sf_dir):
    n = F.col("name")
    return named(spark, sf_dir).select("p_partkey", T.clean_text(n).alias("clean"), F.array_join(T.name_tokens(n), "|").alias("tokens"), F.array_join(T.numbers(n), "|").alias("numbers"), F.array_join(F.array_sort(T.token_set(n)), "|").alias("words"))


LATIN = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' TS-' || p_size || 'C set' WHEN 1 THEN '777 ' || p_name || ' AB-12 big paper box' WHEN 2 THEN ' ' || p_name || '-x_y.z' WHEN 3 THEN 'ab' ELSE p_name || ' ' || lower(p_type) || ' 12AB deluxe extra cup 99' END"


def codes_sql(name: str) -> str:
    for p in T.MODEL_CODES:
        name = rf"trim(regexp_replace({name}, '(?i)\b({p})\b', '', 'g'))" if p == T.MODEL_CODES[-1] else rf"regexp_replace({name}, '(?i)\b({p})\b', '', 'g')"
    return rf"trim(regexp_replace({name}, '\s+', ' ', 'g'))"


@query(
    rf"WITH l AS (SELECT p_partkey, {LATIN} AS name FROM part), b AS (SELECT *, trim(name) AS whole, {codes_sql('trim(name)')} AS bare FROM l), "
    r"w AS (SELECT *, list_filter(string_split_regex(bare, '\s+'), lambda x: x <> '') AS parts FROM b), e AS (SELECT *, CASE WHEN len(parts) >= 5 THEN parts[1] || ' ' || parts[-2] || ' ' || parts[-1] WHEN len(parts) >= 3 THEN parts[1] || ' ' || parts[-1] END AS ends FROM w), "
    r"v AS (SELECT p_partkey, parts, name, list_filter(list_transform([whole, CASE WHEN length(bare) > 3 THEN bare END, CASE WHEN length(ends) > 3 THEN ends END, regexp_replace(name, '\b777\b', '쓰리쎄븐', 'g'), regexp_replace(bare, '\b777\b', '쓰리쎄븐', 'g'), name, bare, "
    r"trim(regexp_replace(regexp_replace(name, '[-_+.,#]', ' ', 'g'), '\s+', ' ', 'g'))], lambda x: trim(x)), lambda x: length(x) > 2) AS k FROM e) "
    "SELECT p_partkey, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:4], '|') AS keywords FROM v"
)
def keyword_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{LATIN} AS name").select("p_partkey", F.array_join(T.keyword_variations(F.col("name")), "|").alias("keywords"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    rf"WITH l AS (SELECT p_partkey, {LATIN} || CASE WHEN p_partkey % 2 = 0 THEN ' 신 용' ELSE '' END AS name FROM part), b AS (SELECT *, trim(regexp_replace(regexp_replace(name, '(?i)\b([A-Z]+[-]?\d+[-]?[A-Za-z0-9]*)\b', '', 'g'), '\s+', ' ', 'g')) AS bare FROM l), "
    r"w AS (SELECT *, list_filter(string_split_regex(CASE WHEN bare = '' THEN name ELSE bare END, '\s+'), lambda x: x <> '') AS parts FROM b), "
    rf"g AS (SELECT *, list_filter(parts[1:1], lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS one, list_filter(parts[2:len(parts) - 1], lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS mid, list_filter(parts[len(parts):], lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS last FROM w) "
    "SELECT p_partkey, array_to_string(CASE WHEN len(parts) <= 3 THEN parts ELSE list_concat(list_concat(one, list_transform(list_sort(list_transform(mid, lambda x, i: {'l': -length(x), 'i': i, 'w': x})), lambda s: s.w)[1:2 - len(one)]), last)[1:3] END, '|') AS keywords FROM g"
)
def main_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{LATIN} || CASE WHEN p_partkey % 2 = 0 THEN ' 신 용' ELSE '' END AS name")
    return rows.select("p_partkey", F.array_join(T.meaningful_keywords(F.col("name")), "|").alias("keywords"))


QUANTITY = "CASE p_partkey % 8 WHEN 0 THEN '100~199' WHEN 1 THEN '1,200' WHEN 2 THEN '50 미만' WHEN 3 THEN '(1,00)' WHEN 4 THEN ' -12.5 %' WHEN 5 THEN NULL WHEN 6 THEN p_size || '-' || p_partkey ELSE p_size || '.7' END"
NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


ACCOUNTING = r"regexp_replace(regexp_replace(t, '[,\s]', '', 'g'), '^\((.*)\)$', '-\1')"


def number_sql(c: str) -> str:
    text = rf"regexp_replace(trim({c}), '[,%\s]', '', 'g')"
    return f"CASE WHEN regexp_matches({text}, {NUMBER}) THEN try_cast({text} AS DOUBLE) END"


@query(
    rf"WITH q AS (SELECT p_partkey, {QUANTITY} AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, '미만') THEN 0 ELSE coalesce(try_cast(regexp_replace(t, '\D', '', 'g') AS BIGINT), 0) END::BIGINT AS digits, "
    r"try_cast(regexp_replace(split_part(split_part(t, '~', 1), '-', 1), '\D', '', 'g') AS BIGINT) AS range_start, CASE WHEN floor(try_cast(replace(t, ',', '') AS DOUBLE)) > 0 THEN floor(try_cast(replace(t, ',', '') AS DOUBLE))::BIGINT END AS whole, "
    rf"{number_sql('t')} AS number, {number_sql(ACCOUNTING)} AS accounting FROM q"
)
def quantity_cells(spark, sf_dir):
    t = F.col("t")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{QUANTITY} AS t")
    return rows.select("p_partkey", T.digits_or_zero(t).alias("digits"), T.range_start(t).alias("range_start"), T.whole_quantity(t).alias("whole"), N.to_number(t).alias("number"), N.accounting_number(t).alias("accounting"))


# ---------------------------------------------------------------- addresses
ADDRESS = (
    "CASE page_id % 9 WHEN 0 THEN url || '&it_id=A_' || page_id WHEN 1 THEN 'http://shop.example.com/goods/view.php?goodsNo=' || page_id WHEN 2 THEN '//img.example.com/a/' || page_id || '.JPG?x=1' WHEN 3 THEN 'img.example.com' || chr(92) || 'up' || chr(92) || page_id || '.png' "
    "WHEN 4 THEN NULL WHEN 5 THEN 'http://img.example.com/upload/' || page_id || '.jpeg' WHEN 6 THEN './pics/' || page_id || '.gif' WHEN 7 THEN '/upload/x' || page_id || '.aspx' ELSE url END"
)
ADDRESSES = f"a AS (SELECT page_id, {ADDRESS} AS u FROM pages)"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{ADDRESS} AS u")


EXT = r"lower(regexp_extract(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\.[^./]*)$', 1))"
PAGE_EXT = ", ".join(f"'{e}'" for e in T.PAGE_EXTENSIONS)
IMAGE_EXT = ", ".join(f"'{e}'" for e in T.IMAGE_EXTENSIONS)


@query(
    rf"WITH {ADDRESSES}, n AS (SELECT *, regexp_extract(regexp_replace(u, '[?#].*$', ''), '([^/]*)/?$', 1) AS last, {EXT} AS e, translate(trim(u), chr(92), '/') AS s FROM a), m AS (SELECT *, CASE WHEN starts_with(s, '//') THEN 'https:' || s ELSE s END AS v FROM n) "
    "SELECT page_id, coalesce(nullif(regexp_extract(u, '[?&]it_id=([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '[?&]goodsNo=([A-Za-z0-9_-]+)', 1), ''), CASE WHEN regexp_matches(last, '^[A-Za-z0-9]+$') THEN last END) AS id, "
    "CASE WHEN starts_with(v, 'img.example.com') THEN 'https://' || v WHEN starts_with(v, 'http://img.example.com') THEN 'https://' || substr(v, 8) ELSE v END AS plain, e AS extension, "
    f"coalesce(e <> '' AND length(e) <= 5 AND e NOT IN ({PAGE_EXT}), false) AS image, CASE WHEN e NOT IN ({PAGE_EXT}) THEN md5(u) || CASE WHEN e IN ({IMAGE_EXT}) THEN e ELSE '.jpg' END END AS cached FROM m"
)
def url_cells(spark, sf_dir):
    u = F.col("u")
    return addresses(spark, sf_dir).select("page_id", T.url_id(u).alias("id"), T.normalise_url(u, ("img.example.com",)).alias("plain"), T.url_extension(u).alias("extension"), T.is_image_url(u).alias("image"), T.cached_file(u).alias("cached"))


@query(
    rf"WITH {ADDRESSES}, r AS (SELECT page_id, coalesce(u, '') AS u FROM a), f AS (SELECT *, CASE WHEN starts_with(u, '//') THEN 'https:' || u ELSE u END AS v FROM r), "
    r"p AS (SELECT *, regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM f), "
    "j AS (SELECT *, CASE WHEN starts_with(u, './') THEN substr(u, 3) ELSE u END AS s FROM p), k AS (SELECT *, CASE WHEN starts_with(s, '/') THEN s ELSE '/' || s END AS rel FROM j), "
    "x AS (SELECT *, replace('https://img.example.com' || CASE WHEN starts_with(rel, '/upload/') THEN '/ez' || rel ELSE rel END, '/ez/ez/', '/ez/') AS joined FROM k) "
    "SELECT page_id, CASE WHEN u = '' OR starts_with(u, 'data:image/') THEN '' WHEN regexp_matches(v, '^https?://') THEN CASE WHEN contains(host, 'img.example.com') AND NOT contains(path, '/ez/') AND starts_with(path, '/upload/') "
    "THEN regexp_extract(v, '^(https?)', 1) || '://' || host || '/ez' || path ELSE v END ELSE joined END AS url, CASE WHEN u = '' OR starts_with(u, 'data:image/') THEN false WHEN regexp_matches(v, '^https?://') THEN contains(host, 'img.example.com') OR (host <> '' AND path <> '') ELSE true END AS valid FROM x"
)
def image_addresses(spark, sf_dir):
    got = T.normalise_image_url(F.col("u"), "https://img.example.com", ("img.example.com",))
    return addresses(spark, sf_dir).select("page_id", got["url"].alias("url"), got["valid"].alias("valid"))


# ---------------------------------------------------------------- offers and matches
PRODUCT = "p_partkey AS product_id, p_name, p_size AS base_qty, CAST(p_retailprice AS DOUBLE) AS base_price"
OFFER = (
    "product_id, ordinal, qty, price, base_price, base_hash, CASE (ordinal + product_id) % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name || ' ' || qty END AS name, "
    "CAST((ordinal * 7 + product_id) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS text_sim, CAST((ordinal * 3 + product_id) % 31 AS DOUBLE) / CAST(30 AS DOUBLE) AS image_sim, "
    "CASE (ordinal + 2 * product_id) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'img/k_' || base_hash || '_1.jpg' ELSE 'img/k_' || substr(md5(CAST(ordinal AS STRING)), 1, 16) || '.jpg' END AS image_path, "
    "CASE WHEN product_id % 9 = 0 THEN NULL ELSE 'base_' || base_hash || '.jpg' END AS base_image"
)
OFFERS = (
    f"products AS (SELECT {PRODUCT}, {hash_sql('p_name')} AS base_hash FROM part), lines AS (SELECT l_partkey AS product_id, l_suppkey AS ordinal, max(l_quantity)::INT AS qty, min(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY ALL), "
    f"offers AS (SELECT {OFFER} FROM lines JOIN products USING (product_id)), hits AS (SELECT *, coalesce(base_hash <> '' AND {file_hash_sql('image_path')} = base_hash, false) AS hit FROM offers)"
)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*PRODUCT.split(", ")).withColumn("base_hash", T.name_hash(F.col("p_name")))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("ordinal"))
    lines = lines.agg(F.max("l_quantity").cast("int").alias("qty"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    both = lines.join(products(spark, sf_dir), "product_id")
    both.createOrReplaceTempView("__offers")
    out = spark.sql(f"SELECT {OFFER} FROM __offers")
    spark.catalog.dropTempView("__offers")
    return out


def _best_sql(source: str, rest: int) -> str:
    wt, wi, floor = {"k": (0.6, 0.4, 0.2), "n": (0.7, 0.3, 0.3)}[source]
    far = "coalesce(base_price > 0 AND price > 0 AND abs(price - base_price) / base_price * 100 > 70, false)"
    more = f" WHERE combined >= 0.35::DOUBLE AND NOT ({far} AND combined < 0.55::DOUBLE)" if source == "n" else ""
    return (
        f"{source}_gate AS (SELECT * FROM hits WHERE ordinal % 2 = {rest} QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY product_id)), "
        f"{source}_score AS (SELECT *, text_sim * {wt}::DOUBLE + image_sim * {wi}::DOUBLE AS combined FROM {source}_gate WHERE coalesce(name, '') <> '' AND text_sim >= {floor}::DOUBLE AND base_image IS NOT NULL AND image_path IS NOT NULL AND image_sim >= 0.8::DOUBLE), "
        f"{source}_top AS (SELECT * FROM {source}_score WHERE combined > 0 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY combined DESC, ordinal) = 1), "
        f"{source} AS (SELECT * FROM {source}_top{more})"
    )


BEST = "product_id, ordinal, name, price, text_sim, image_sim, combined"


@query(f"WITH {OFFERS}, {_best_sql('k', 0)} SELECT {BEST} FROM k")
def best_match_k(spark, sf_dir):
    return matching.best_match(offers(spark, sf_dir).filter("ordinal % 2 = 0"), "k").select(*BEST.split(", "))


@query(f"WITH {OFFERS}, {_best_sql('n', 1)} SELECT {BEST} FROM n")
def best_match_n(spark, sf_dir):
    return matching.best_match(offers(spark, sf_dir).filter("ordinal % 2 = 1"), "n").select(*BEST.split(", "))


@query(
    f"WITH {OFFERS}, {_best_sql('k', 0)}, {_best_sql('n', 1)}, j AS (SELECT p.product_id, k.name AS k_name, k.combined AS kc, coalesce(k.text_sim, 0) AS k_text_sim, coalesce(k.image_sim, 0) AS k_image_sim, n.name AS n_name, n.combined AS nc, coalesce(n.text_sim, k.text_sim, 0) AS n_text_sim, coalesce(n.image_sim, k.image_sim, 0) AS n_image_sim "
    "FROM products p LEFT JOIN k USING (product_id) LEFT JOIN n USING (product_id)), s AS (SELECT *, greatest(coalesce(kc, 0), coalesce(nc, 0)) AS score FROM j) SELECT product_id, k_name, n_name, k_text_sim, k_image_sim, n_text_sim, n_image_sim, score, "
    "CASE WHEN kc IS NOT NULL AND (nc IS NULL OR kc >= nc) THEN 'k' WHEN nc IS NOT NULL THEN 'n' END AS winner, CASE WHEN nc IS NOT NULL THEN 'n' WHEN kc IS NOT NULL THEN 'k' END AS site, CASE WHEN kc IS NULL AND nc IS NULL THEN 'N' ELSE 'Y' END AS matched, "
    "CASE WHEN kc IS NULL AND nc IS NULL THEN 'none' WHEN score >= 0.95 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'rejected' END AS quality, CASE WHEN nc > 0.8 THEN 'high' WHEN nc > 0.6 THEN 'mid' WHEN nc IS NOT NULL THEN 'low' END AS n_grade FROM s"
)
def match_products(spark, sf_dir):
    o = offers(spark, sf_dir)
    k, n = matching.best_match(o.filter("ordinal % 2 = 0"), "k"), matching.best_match(o.filter("ordinal % 2 = 1"), "n")
    got = matching.match_product(products(spark, sf_dir).select("product_id"), k, n)
    return got.select("product_id", "k_name", "n_name", "k_text_sim", "k_image_sim", "n_text_sim", "n_image_sim", "score", "winner", "site", "matched", "quality", "n_grade")


@query(f"WITH {OFFERS} SELECT product_id, ordinal, image_path FROM hits QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY product_id)")
def hash_gate(spark, sf_dir):
    """Offers whose image carries the product's hash; all of a product's where none does."""
    return joins.hash_or_all(offers(spark, sf_dir), ["product_id"], "base_hash", "image_path").select("product_id", "ordinal", "image_path")


@query(f"WITH {OFFERS}, m AS (SELECT product_id, max(combined) AS c FROM (SELECT product_id, text_sim AS combined FROM offers) GROUP BY product_id) SELECT round(avg(CASE WHEN c > 0.9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS rate FROM m")
def match_rate(spark, sf_dir):
    best = offers(spark, sf_dir).groupBy("product_id").agg(F.max("text_sim").alias("c")).withColumn("matched", F.when(F.col("c") > 0.9, "Y").otherwise("N"))
    return best.agg(F.round(matching.match_rate(F.col("matched")), 9).alias("rate"))


@query(
    f"WITH {OFFERS}, ok AS (SELECT * FROM offers WHERE text_sim >= 0.7), sure AS (SELECT product_id, min(ordinal) AS ordinal FROM ok WHERE text_sim > 0.95 GROUP BY product_id), top AS (SELECT product_id, ordinal FROM ok QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY text_sim DESC, ordinal) = 1) "
    "SELECT product_id, coalesce(s.ordinal, t.ordinal) AS ordinal FROM top t LEFT JOIN sure s USING (product_id)"
)
def early_exit_match(spark, sf_dir):
    return ranking.best_with_early_exit(offers(spark, sf_dir).select("product_id", "ordinal", "text_sim"), ["product_id"], "text_sim", "ordinal").select("product_id", "ordinal")


@query(f"WITH {OFFERS}, t AS (SELECT product_id, ordinal, text_sim FROM offers WHERE text_sim >= 0.75 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY text_sim DESC, ordinal) = 1) SELECT p.product_id, p_name, t.ordinal, t.text_sim FROM products p LEFT JOIN t USING (product_id)")
def best_pairs(spark, sf_dir):
    scored = offers(spark, sf_dir).select("product_id", "ordinal", "text_sim")
    return joins.best_pairs(scored, products(spark, sf_dir).select("product_id", "p_name"), "product_id", "text_sim", "ordinal", 0.75)


@query(f"WITH {OFFERS} SELECT product_id, ordinal, text_sim FROM offers WHERE text_sim >= 0.97")
def above_threshold(spark, sf_dir):
    return ranking.above_threshold(offers(spark, sf_dir), "text_sim", "ordinal", 0.97).select("product_id", "ordinal", "text_sim")


@query(f"WITH {OFFERS} SELECT product_id, ordinal FROM offers QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ordinal) <= 5")
def unscored_candidates(spark, sf_dir):
    """Without a scorer the first five candidates of each product stay."""
    return ranking.above_threshold(offers(spark, sf_dir), "text_sim", "ordinal", None, ["product_id"]).select("product_id", "ordinal")


@query(f"WITH {OFFERS}, t AS (SELECT * FROM offers WHERE text_sim >= 0.5) SELECT ordinal, product_id, text_sim FROM t ORDER BY text_sim DESC, product_id * 1000 + ordinal LIMIT 1")
def most_similar(spark, sf_dir):
    rows = offers(spark, sf_dir).withColumn("at", F.col("product_id") * 1000 + F.col("ordinal"))
    return ranking.top_one(rows, "text_sim", "at", 0.5).select("ordinal", "product_id", "text_sim")


@query(f"WITH {OFFERS}, v AS (SELECT DISTINCT product_id, 'name_' || ordinal || '.jpg' AS name FROM offers WHERE ordinal % 11 > 5 OR coalesce((ordinal % 11)::DOUBLE / nullif(ordinal % 7, 0) > 0.5, false)) SELECT product_id, array_to_string(list_sort(list(name)), ', ') AS names FROM v GROUP BY product_id")
def verified_names(spark, sf_dir):
    rows = offers(spark, sf_dir).select("product_id", (F.col("ordinal") % 11).alias("inliers"), (F.col("ordinal") % 7).alias("good"), F.concat(F.lit("name_"), F.col("ordinal").cast("string"), F.lit(".jpg")).alias("name"))
    return joins.verified_names(rows, "inliers", "good", 5, "name", "product_id")


@query(
    "WITH v AS (SELECT vec_id, vec_id // 50 AS gallery, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS sim FROM v a JOIN v b USING (gallery)"
)
def similarity_matrix(spark, sf_dir):
    """The matrix of each gallery of 50 vectors; every vector is in one."""
    v = table(spark, sf_dir, "embeddings").withColumn("gallery", F.floor(F.col("vec_id") / 50))
    return joins.similarity_matrix(v, ["gallery"]).withColumn("sim", F.round("sim", 6))


# ---------------------------------------------------------------- images by hash
IMAGE_FILES = (
    f"files AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'k' ELSE 'n' END AS source, p_partkey AS ordinal, CASE p_partkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'k' ELSE 'n' END || '_' || {hash_sql('p_name')} || '_' || p_partkey || '.jpg' AS path FROM part)"
)


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    source = F.when(F.col("p_partkey") % 3 == 0, "base").when(F.col("p_partkey") % 3 == 1, "k").otherwise("n")
    return p.select(source.alias("source"), F.col("p_partkey").alias("ordinal"), F.concat(source, F.lit("_"), T.name_hash(F.col("p_name")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), F.lit(None).cast("string").alias("product_hash"))


def named_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("product_name"))


ONE_USE = (
    f"{IMAGE_FILES}, p AS (SELECT p_partkey AS ordinal, p_name AS product_name, {hash_sql('p_name')} AS h, row_number() OVER (PARTITION BY {hash_sql('p_name')} ORDER BY p_partkey) AS i FROM part), "
    f"f AS (SELECT source, path, {file_hash_sql('path')} AS h, row_number() OVER (PARTITION BY source, {file_hash_sql('path')} ORDER BY ordinal) AS i FROM files), u AS (SELECT p.ordinal, product_name, source, path FROM p JOIN f USING (h, i))"
)


@query(f"WITH {ONE_USE} SELECT * FROM u")
def one_use_images(spark, sf_dir):
    return joins.one_use_images(named_products(spark, sf_dir), image_files(spark, sf_dir))


@query(
    f"WITH {ONE_USE} SELECT p.ordinal, p.product_name, b.path AS base, k.path AS k, n.path AS n, CASE WHEN k.path IS NOT NULL THEN 0.95::DOUBLE END AS k_score, CASE WHEN n.path IS NOT NULL THEN 0.95::DOUBLE END AS n_score FROM p LEFT JOIN (SELECT * FROM u WHERE source = 'base') b USING (ordinal) "
    "LEFT JOIN (SELECT * FROM u WHERE source = 'k') k USING (ordinal) LEFT JOIN (SELECT * FROM u WHERE source = 'n') n USING (ordinal)"
)
def three_images(spark, sf_dir):
    return joins.three_images(named_products(spark, sf_dir), image_files(spark, sf_dir))


@query(f"WITH {IMAGE_FILES}, x AS (SELECT min(p_partkey) AS ordinal, p_name AS product_name FROM part GROUP BY p_name) SELECT x.ordinal AS product, x.product_name, f.path FROM x JOIN files f ON {file_hash_sql('f.path')} = {hash_sql('x.product_name')}")
def images_by_hash(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("product_name")).agg(F.min("p_partkey").alias("product"))
    return joins.images_by_hash(p, image_files(spark, sf_dir).select("path")).select("product", "product_name", "path")


@query(
    r"WITH f AS (SELECT p_partkey, 'pics/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '_nobg' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' ELSE '.txt' END AS path FROM part), g AS (SELECT DISTINCT path FROM f WHERE regexp_matches(lower(path), '\.(jpe?g|png|gif)$')), "
    rf"s AS (SELECT path, regexp_replace({stem_sql('path')}, '_nobg$', '') AS base_name, NOT ends_with({stem_sql('path')}, '_nobg') AS is_original, lower(regexp_extract(path, '(\.[^.]*)$', 1)) AS extension FROM g) "
    "SELECT base_name, path, is_original, extension FROM s QUALIFY row_number() OVER (PARTITION BY base_name ORDER BY NOT is_original, extension NOT IN ('.jpg', '.jpeg'), path) = 1"
)
def image_metadata(spark, sf_dir):
    ext = F.when(F.col("p_partkey") % 4 == 0, ".png").when(F.col("p_partkey") % 4 == 1, ".JPG").when(F.col("p_partkey") % 4 == 2, ".jpeg").otherwise(".txt")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("pics/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "_nobg").otherwise(""), ext).alias("path")).distinct()
    return images.image_metadata(files).select("base_name", "path", "is_original", "extension")


# ---------------------------------------------------------------- scores
@query(
    rf"WITH {NAMED}, t AS (SELECT a.p_partkey, a.name AS a, b.name AS b FROM named a JOIN named b ON b.p_partkey = a.p_partkey + 8), n AS (SELECT *, regexp_extract_all(coalesce(a, ''), '\d+') AS x, regexp_extract_all(coalesce(b, ''), '\d+') AS y, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb, "
    r"list_distinct(list_filter(string_split_regex(lower(a), '\s+'), lambda w: w <> '')) AS wa, list_distinct(list_filter(string_split_regex(lower(b), '\s+'), lambda w: w <> '')) AS wb FROM t) "
    "SELECT p_partkey, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0.5::DOUBLE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(list_intersect(x, y)))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS number_score, len(list_distinct(list_intersect(ta, tb)))::INT AS common, "
    "CASE WHEN len(list_distinct(list_concat(ta, tb))) > 0 THEN least(1.0::DOUBLE, len(list_distinct(list_intersect(ta, tb)))::DOUBLE / len(list_distinct(list_concat(ta, tb))) * (1.0::DOUBLE + 0.1::DOUBLE * len(list_filter(list_distinct(list_intersect(ta, tb)), lambda w: length(w) >= 4)))) ELSE 0.0::DOUBLE END AS legacy, "
    "round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * 0.7::DOUBLE + CASE WHEN greatest(len(wa), len(wb)) > 0 THEN len(list_intersect(wa, wb))::DOUBLE / greatest(len(wa), len(wb)) ELSE 0 END * 0.3::DOUBLE)), 9) AS fallback, least(1.0::DOUBLE, 0.8::DOUBLE + CASE WHEN p_partkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) AS bonus FROM n WHERE a IS NOT NULL"
)
def name_scores(spark, sf_dir):
    n = named(spark, sf_dir)
    t = n.select("p_partkey", F.col("name").alias("a")).join(n.select((F.col("p_partkey") - 8).alias("p_partkey"), F.col("name").alias("b")), "p_partkey").filter("a IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    ta, tb = T.name_tokens(a), T.name_tokens(b)
    return t.select(
        "p_partkey", M.number_score(a, b).alias("number_score"), M.common_tokens(a, b).alias("common"), M.legacy_token_similarity(ta, tb).alias("legacy"),
        F.round(M.fallback_text_similarity(F.lit(0.5), a, b), 9).alias("fallback"), M.with_exact_bonus(F.lit(0.8), F.col("p_partkey") % 2 == 0).alias("bonus"),
    )


SCORES = "CAST(p_partkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS sift, CAST(p_size % 8 AS DOUBLE) / CAST(7 AS DOUBLE) AS akaze, CAST((p_partkey * 3) % 13 AS DOUBLE) / CAST(12 AS DOUBLE) AS deep, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) / CAST(4 AS DOUBLE) END AS orb"


@query(
    f"WITH c AS (SELECT p_partkey, p_size, {SCORES} FROM part), s AS (SELECT *, coalesce(orb, 0) AS o FROM c), t AS (SELECT *, (sift * 0.4::DOUBLE + akaze * 0.3::DOUBLE + deep * 0.2::DOUBLE + o * 0.1::DOUBLE) / (0.4::DOUBLE + 0.3 + 0.2 + 0.1) AS mean, [sift, akaze, deep, o] AS l FROM s), "
    "n AS (SELECT *, len(list_filter(l, lambda x: x >= 0.6::DOUBLE)) AS high, len(list_filter(l, lambda x: x >= 0.3::DOUBLE AND x < 0.6::DOUBLE)) AS mid, len(list_filter(l, lambda x: x >= 0.1::DOUBLE AND x < 0.3::DOUBLE)) AS low, list_max(l) AS best, list_filter(l, lambda x: x > 0.01::DOUBLE) AS present FROM t), "
    "f AS (SELECT *, greatest(mean, best * CASE WHEN high >= 2 THEN 0.8::DOUBLE WHEN high = 1 AND mid >= 1 THEN 0.7::DOUBLE WHEN mid >= 2 THEN 0.6::DOUBLE WHEN mid = 1 AND low >= 1 THEN 0.5::DOUBLE WHEN high = 0 AND low >= 2 THEN 0.3::DOUBLE WHEN high >= 1 AND low >= 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS lifted FROM n), "
    "g AS (SELECT *, CASE WHEN sift >= 0.4::DOUBLE AND akaze >= 0.4::DOUBLE THEN least(1.0::DOUBLE, lifted * 1.15::DOUBLE) ELSE lifted END AS boosted FROM f) "
    "SELECT p_partkey, round(CASE WHEN len(present) >= 2 THEN least(1.0::DOUBLE, boosted * (1 + least(0.1::DOUBLE, greatest(0.0::DOUBLE, 1 - list_stddev_pop(present)) * 0.2::DOUBLE))) ELSE boosted END, 9) AS score, "
    "CASE WHEN p_partkey % 10 = 0 THEN 0.0::DOUBLE WHEN p_partkey % 10 = 1 THEN 1.0::DOUBLE ELSE sift END AS same, round(least(1.0::DOUBLE, 2 * CASE WHEN p_size % 9 >= 5 THEN (p_size % 9)::DOUBLE / 20 * 0.6::DOUBLE + 3.0::DOUBLE / (p_size % 9) * 0.4::DOUBLE ELSE (p_size % 9)::DOUBLE / 20 END), 9) AS keypoints FROM g"
)
def combined_image_score(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", *[f"{x}" for x in SCORES.split(", C")[:1]], *[f"C{x}" for x in SCORES.split(", C")[1:]])
    a = F.when(F.col("p_partkey") % 10 != 0, "a")
    b = F.when(F.col("p_partkey") % 10 == 1, "a").otherwise("b")
    return rows.select(
        "p_partkey", F.round(M.image_score(F.col("sift"), F.col("akaze"), F.col("deep"), F.col("orb")), 9).alias("score"), M.image_similarity(a, b, F.col("sift")).alias("same"),
        F.round(M.keypoint_score((F.col("p_size") % 9).cast("double"), F.lit(3.0), F.lit(20), F.lit(30)), 9).alias("keypoints"),
    )


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) "
    "SELECT vec_id, round(c, 6) AS cosine, round(c * 0.6::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE + 0.25::DOUBLE * 0.2::DOUBLE, 6) AS ensemble, round((c * 0.7::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE) * 0.7::DOUBLE + 0.25::DOUBLE * 0.3::DOUBLE, 6) AS deep FROM p"
)
def vector_scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", M.cosine(F.col("embedding"), F.col("other")).alias("c"))
    c, x, y = F.col("c"), F.lit(0.5), F.lit(0.25)
    return p.select("vec_id", F.round(c, 6).alias("cosine"), F.round(M.ensemble(c, x, y), 6).alias("ensemble"), F.round(M.deep(c, x, y), 6).alias("deep"))


# ---------------------------------------------------------------- sellers and search results
SELLER = "CASE s_suppkey % 12 WHEN 0 THEN '네이버 스토어' WHEN 1 THEN '쿠팡 공식' WHEN 2 THEN 'G마켓' WHEN 3 THEN '옥션몰' WHEN 4 THEN '행복기프트' WHEN 5 THEN '답례품 천국' WHEN 6 THEN '단체선물몰' WHEN 7 THEN '11번가' WHEN 8 THEN NULL WHEN 9 THEN '티몬' WHEN 10 THEN s_name || ' 품절' ELSE s_name END"


def _any(c: str, words: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ", false)"


def _types() -> str:
    from .. import schema as S

    return "CASE " + " ".join(f"WHEN {_any('seller', words)} THEN '{label}'" for words, label in S.SUPPLIER_TYPES) + f" ELSE '{S.SUPPLIER_OTHER}' END"


def _lists() -> dict[str, tuple[str, ...]]:
    from .. import schema as S

    return {"site": S.PROMO_SITE, "supplier": S.PROMO_SUPPLIER}


@query(
    f"WITH s AS (SELECT s_suppkey, {SELLER} AS seller FROM supplier) SELECT s_suppkey, {_types()} AS kind, {_any('seller', _lists()['supplier'])} AS promo, "
    f"array_to_string(list_filter([{', '.join(repr(w) for w in _lists()['site'])}], lambda w: contains(lower(concat_ws(chr(10), seller, 'http://x/' || s_suppkey)), lower(w))), ',') AS words FROM s"
)
def seller_kinds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{SELLER} AS seller")
    found = filters.promotional(F.lit(None).cast("string"), F.col("seller"), F.concat(F.lit("http://x/"), F.col("s_suppkey").cast("string")))
    return s.select("s_suppkey", images.supplier_type(F.col("seller")).alias("kind"), filters.promotional_supplier(F.col("seller")).alias("promo"), F.array_join(found["words"], ",").alias("words"))


HIT = f"SELECT l_partkey, l_suppkey, p_name AS query, CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) || ' 세트' WHEN 1 THEN 'other thing' WHEN 2 THEN p_name || ' 판촉물' ELSE 'best ' || p_name END AS title, {SELLER} AS seller, CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN 'free' WHEN 2 THEN NULL ELSE CAST(CAST(l_quantity AS INT) * 100 AS STRING) END AS price"
WORDS = r"list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '\s+'), lambda x: x <> ''))"


@query(
    f"WITH h AS ({HIT} FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT l_partkey, l_suppkey, title, seller, price FROM h WHERE CASE WHEN regexp_matches(price, '^[0-9]+$') THEN try_cast(price AS BIGINT) ELSE 0 END > 0 "
    f"AND len(list_intersect({WORDS.format('query')}, {WORDS.format('title')})) > 0 AND NOT {_any('lower(title)', _lists()['site'])} AND NOT {_any('lower(seller)', _lists()['site'])}"
)
def admitted_offers(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    h.createOrReplaceTempView("__hits")
    rows = spark.sql(f"{HIT} FROM __hits")
    spark.catalog.dropTempView("__hits")
    return filters.admit_offers(rows).select("l_partkey", "l_suppkey", "title", "seller", "price")


@query(f"WITH s AS (SELECT s_suppkey, {SELLER} AS seller FROM supplier) SELECT s_suppkey FROM s WHERE NOT coalesce(contains(seller, '품절'), false)")
def in_stock(spark, sf_dir):
    return filters.in_stock(table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{SELLER} AS seller"), "seller").select("s_suppkey")


@query("SELECT s_suppkey, coalesce(CASE WHEN contains(h, 'koreagift') THEN 'promo' WHEN h = '' THEN 'unknown' ELSE split_part(h, '.', 1) END, 'unknown') AS supplier FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'www.koreagift.example' WHEN 1 THEN 'shop' || s_suppkey || '.example.com' WHEN 2 THEN '' END AS h FROM supplier)")
def suppliers_of_links(spark, sf_dir):
    k = F.col("s_suppkey")
    link = F.when(k % 4 == 0, "https://www.koreagift.example/a?b").when(k % 4 == 1, F.concat(F.lit("http://www.shop"), k.cast("string"), F.lit(".example.com/x"))).when(k % 4 == 2, "no link")
    return table(spark, sf_dir, "supplier").select("s_suppkey", images.supplier_of_link(link, {"koreagift": "promo"}).alias("supplier"))


# ---------------------------------------------------------------- aggregates and orders
@query(
    "WITH d AS (SELECT event_type, [value / 100, (event_id % 7)::DOUBLE / 7, 0.0::DOUBLE] AS s, event_id FROM events), x AS (SELECT event_id, list_filter(s, lambda v: v > 0.01::DOUBLE) AS t, s FROM d) SELECT event_id, round(CASE WHEN len(t) >= 2 THEN 1 - list_stddev_pop(t) END, 9) AS consensus, list_sort(s)[2] AS median FROM x"
)
def consensus(spark, sf_dir):
    s = F.array(F.col("value") / 100, (F.col("event_id") % 7).cast("double") / 7, F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(aggregates.consensus(s), 9).alias("consensus"), aggregates.upper_median(s).alias("median"))


@query(f"WITH {OFFERS} SELECT count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit)::DOUBLE / count(*) AS share, CASE WHEN count(*) FILTER (hit)::DOUBLE / count(*) >= 0.8 THEN 'high' WHEN count(*) FILTER (hit)::DOUBLE / count(*) >= 0.6 THEN 'medium' ELSE 'low' END AS efficiency FROM hits")
def hash_statistics(spark, sf_dir):
    rows = offers(spark, sf_dir).select("product_id", (T.file_hash(F.col("image_path")) == F.col("base_hash")).alias("hit"))
    return aggregates.hash_statistics(rows.withColumn("hit", F.coalesce("hit", F.lit(False))), "hit", "product_id")


@query(f"WITH {OFFERS} SELECT count(*) AS n_rows, count(base_image) AS base_image_n, count(base_image) * 100.0::DOUBLE / count(*) AS base_image_pct, count(image_path) AS k_image_n, count(image_path) * 100.0::DOUBLE / count(*) AS k_image_pct FROM offers")
def image_summary(spark, sf_dir):
    return aggregates.image_summary(offers(spark, sf_dir).withColumnRenamed("image_path", "k_image"), ("base_image", "k_image"))


@query("SELECT count(*) FILTER (starts_with(url, 'http') AND contains(lower(url), 'example.com')) AS com, count(*) FILTER (starts_with(url, 'http') AND contains(lower(url), 'example.net')) AS net FROM pages")
def host_counts(spark, sf_dir):
    return aggregates.host_counts(table(spark, sf_dir, "pages"), "url", {"com": "example.com", "net": "example.net"})


CHECKED = "CASE p_partkey % 6 WHEN 0 THEN '-' WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN '1,200' ELSE p_brand END"


@query(
    f"WITH c AS (SELECT {CHECKED} AS base_price, p_name AS product_name FROM part) SELECT 'product_name' AS \"column\", count(*) FILTER (product_name IS NULL) AS n_blank, NULL::BIGINT AS n_not_numeric FROM c UNION ALL "
    f"SELECT 'base_price', count(*) FILTER (base_price IS NULL OR trim(base_price) IN ('-', '')), count(*) FILTER (base_price IS NOT NULL AND trim(base_price) NOT IN ('-', '') AND ({number_sql('base_price')}) IS NULL) FROM c UNION ALL SELECT 'code', NULL, NULL"
)
def check_input(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr(f"{CHECKED} AS base_price", "p_name AS product_name")
    return aggregates.check_input(c, ("product_name", "base_price", "code"))


@query(f"WITH {OFFERS} SELECT product_id, count(*) AS n, array_to_string(list(ordinal || ':' || qty ORDER BY ordinal), ',') AS offers FROM offers GROUP BY product_id")
def nested_offers(spark, sf_dir):
    got = aggregates.nested_offers(offers(spark, sf_dir).select("product_id", "ordinal", "qty"), "product_id")
    text = F.transform("offers", lambda x: F.concat(x["ordinal"].cast("string"), F.lit(":"), x["qty"].cast("string")))
    return got.select("product_id", F.size("offers").cast("long").alias("n"), F.array_join(text, ",").alias("offers"))


@query(
    "WITH a AS (SELECT p_name AS href, p_partkey AS ordinal, 0 AS f FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_name AS href, p_partkey AS ordinal, 1 AS f FROM part), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT href, ordinal FROM u QUALIFY row_number() OVER (PARTITION BY href ORDER BY f, ordinal) = 1"
)
def concat_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("href"), F.col("p_partkey").alias("ordinal"))
    return ranking.concat_distinct([p.filter("ordinal % 2 = 0"), p], ["href"])


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS p_name FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size <= 10")
def restore_missing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return ranking.restore_missing(p.filter("p_size > 10"), p, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS place FROM part")
def natural_order(spark, sf_dir):
    """The place of each file in its gallery, by natural order of their names: runs of digits count by value."""
    f = table(spark, sf_dir, "part").withColumn("f", F.concat(F.lit("img"), F.col("p_partkey").cast("string")))
    w = Window.partitionBy("p_type", "p_size").orderBy(T.natural_key(F.col("f")), "f")
    return f.select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("WITH t AS (SELECT l_partkey AS p_partkey, l_quantity::INT AS q, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL), m AS (SELECT p_partkey, min(q) AS low FROM t GROUP BY p_partkey), k AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN low ELSE p_size END AS quantity FROM m JOIN part USING (p_partkey)) SELECT k.p_partkey, quantity::INT AS quantity, v AS value FROM k LEFT JOIN t ON t.p_partkey = k.p_partkey AND t.q = k.quantity")
def tier_or_lowest(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("q")).agg(F.min("l_extendedprice").alias("v"))
    t = t.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("q", "v"))).alias("tiers")).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    got = P.tier_or_lowest(F.col("tiers"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")))
    return t.select("p_partkey", got["quantity"].alias("quantity"), got["value"].alias("value"))


# ---------------------------------------------------------------- the comparison from end to end
SIDE_OFFER = (
    "p_name || ' ' || product_id AS product_name, ordinal, CASE WHEN ordinal % 5 = 0 THEN '' ELSE upper(p_name || ' ' || product_id) END AS name, price, 'https://shop.example/' || ordinal AS link, 'seller ' || ordinal AS supplier, "
    "CASE WHEN (ordinal + product_id) % 4 = 0 THEN NULL ELSE 'img/' || ordinal || '.jpg' END AS image_path, CAST((ordinal * 3 + product_id) % 31 AS DOUBLE) / CAST(30 AS DOUBLE) AS image_sim"
)


def _side_sql(s: str, rest: int) -> str:
    wt, wi = {"k": (0.6, 0.4), "n": (0.7, 0.3)}[s]
    far = "coalesce(base_price > 0 AND price > 0 AND abs(price - base_price) / base_price * 100 > 70, false)"
    more = f" WHERE combined >= 0.35::DOUBLE AND NOT ({far} AND combined < 0.55::DOUBLE)" if s == "n" else ""
    return (
        f"{s}s AS (SELECT *, 1.0::DOUBLE * {wt}::DOUBLE + image_sim * {wi}::DOUBLE AS combined FROM so WHERE ordinal % 2 = {rest} AND name <> '' AND image_path IS NOT NULL AND image_sim >= 0.8::DOUBLE), "
        f"{s}b AS (SELECT * FROM {s}s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY combined DESC, ordinal) = 1), "
        f"{s} AS (SELECT product_id, base_qty AS {s}_qty, round_even(price * 1.1, 0) AS {s}_price, round_even(price * 1.1, 0) - base_price AS {s}_diff, round_even((round_even(price * 1.1, 0) - base_price) / base_price * 100, 0) AS {s}_diff_pct, link AS {s}_link, supplier AS {s}_supplier, image_path AS {s}_image FROM {s}b{more})"
    )


def _gone(s: str, columns: str) -> str:
    return ", ".join(f"CASE WHEN NOT coalesce({s}_diff >= 0 OR {s}_diff_pct > -1, false) THEN {s}_{c} END AS {s}_{c}" for c in columns.split())


COMPARED = (
    f"{OFFERS}, so AS (SELECT product_id, base_qty, base_price, {SIDE_OFFER} FROM lines JOIN products USING (product_id) WHERE product_id % 9 <> 0), {_side_sql('k', 0)}, {_side_sql('n', 1)}, "
    f"r AS (SELECT product_id AS ordinal, {_gone('k', 'qty price diff diff_pct link image')}, {_gone('n', 'qty price diff diff_pct link image supplier')} FROM products LEFT JOIN k USING (product_id) LEFT JOIN n USING (product_id))"
)


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = products(spark, sf_dir)
    own = p.select(F.col("product_id").alias("ordinal"), F.concat_ws(" ", "p_name", F.col("product_id").cast("string")).alias("product_name"), "base_qty", "base_price", F.when(F.col("product_id") % 9 != 0, "base.jpg").alias("base_image"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("ordinal")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    lines.join(p, "product_id").createOrReplaceTempView("__sides")
    o = spark.sql(f"SELECT {SIDE_OFFER} FROM __sides")
    spark.catalog.dropTempView("__sides")
    return compare.compare(own, o.filter("ordinal % 2 = 0"), o.filter("ordinal % 2 = 1"))


COMPARED_COLUMNS = "ordinal, k_qty, k_price, k_diff, k_diff_pct, k_link, k_image, n_qty, n_price, n_diff, n_diff_pct, n_link, n_image, n_supplier"


@query(f"WITH {COMPARED} SELECT {COMPARED_COLUMNS} FROM r")
def compared_result(spark, sf_dir):
    """Products, offers and images in, result rows out."""
    return _compared(spark, sf_dir)[0].select(*COMPARED_COLUMNS.split(", "))


@query(f"WITH {COMPARED} SELECT {COMPARED_COLUMNS} FROM r WHERE (coalesce(k_diff < -1, false) OR coalesce(n_diff < -1, false)) AND (k_diff IS NULL OR k_diff < -1) AND (n_diff IS NULL OR n_diff < -1)")
def compared_upload(spark, sf_dir):
    return _compared(spark, sf_dir)[1].select(*COMPARED_COLUMNS.split(", "))


# ---------------------------------------------------------------- the same where names differ and decide
NAMED_OFFER = (
    "p_name || ' TS-' || product_id || 'C 세트' AS product_name, ordinal, CASE ordinal % 6 WHEN 0 THEN p_name || ' 세트 TS-' || product_id || 'C' WHEN 1 THEN p_name || ' (' || ordinal || ')' WHEN 2 THEN 'other thing ' || ordinal "
    "WHEN 3 THEN p_name || ' TS-' || product_id || 'c 세트' WHEN 4 THEN NULL ELSE split_part(p_name, ' ', 2) || ' TS-' || product_id END AS name, price, 'https://shop.example/' || ordinal AS link, 'seller ' || ordinal AS supplier, "
    "'img/' || ordinal || '.jpg' AS image_path, CAST(80 + (ordinal * 7 + product_id) % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS image_sim, CAST((ordinal * 13 + product_id) % 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS model_sim"
)


def _text_sql() -> str:
    """The text score of ``so`` as ``ts``: cleaned names, tokens, numbers and the block ratio of distinct pairs."""
    return (
        f"cl AS (SELECT *, {clean_sql('product_name')} AS x, {clean_sql('name')} AS y FROM so), w AS (SELECT DISTINCT x AS a, y AS b FROM cl WHERE x <> y AND x <> '' AND y <> ''), {BLOCKS}, "
        f"tk AS (SELECT cl.*, coalesce(ratio, 0) AS ratio, {tokens_sql('x')} AS tx, {tokens_sql('y')} AS ty, list_distinct(regexp_extract_all(x, '[0-9]+')) AS nx, list_distinct(regexp_extract_all(y, '[0-9]+')) AS ny FROM cl LEFT JOIN ratios ON a = x AND b = y), "
        "sc AS (SELECT *, len(list_intersect(list_distinct(tx), list_distinct(ty)))::DOUBLE AS c, len(tx) AS n, len(ty) AS m, len(list_distinct(list_concat(tx, ty))) AS u, CASE WHEN len(nx) = 0 AND len(ny) = 0 THEN 0.5::DOUBLE WHEN len(nx) = 0 OR len(ny) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(nx, ny))::DOUBLE / len(list_distinct(list_concat(nx, ny))) END AS num FROM tk), "
        "ts AS (SELECT *, CASE WHEN coalesce(trim(name), '') = '' THEN 0.0::DOUBLE WHEN x = y THEN 1.0::DOUBLE ELSE model_sim * 0.55::DOUBLE + (CASE WHEN n > 0 AND m > 0 THEN 0.5::DOUBLE * (c / u) + 0.5::DOUBLE * (CASE WHEN n > m THEN 0.7::DOUBLE * (c / n) + 0.3::DOUBLE * (c / m) ELSE 0.3::DOUBLE * (c / n) + 0.7::DOUBLE * (c / m) END) ELSE 0.0::DOUBLE END) * 0.2::DOUBLE "
        "+ ratio * 0.1::DOUBLE + num * 0.05::DOUBLE END AS text_sim FROM sc)"
    )


def _named_side_sql(s: str, rest: int) -> str:
    wt, wi, floor = {"k": (0.6, 0.4, 0.2), "n": (0.7, 0.3, 0.3)}[s]
    far = "coalesce(base_price > 0 AND price > 0 AND abs(price - base_price) / base_price * 100 > 70, false)"
    more = f" WHERE combined >= 0.35::DOUBLE AND NOT ({far} AND combined < 0.55::DOUBLE)" if s == "n" else ""
    return (
        f"{s}s AS (SELECT *, text_sim * {wt}::DOUBLE + image_sim * {wi}::DOUBLE AS combined FROM ts WHERE ordinal % 2 = {rest} AND name <> '' AND image_sim >= 0.8::DOUBLE AND text_sim >= {floor}::DOUBLE), "
        f"{s}b AS (SELECT * FROM {s}s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(combined, 9) DESC, ordinal) = 1), {s} AS (SELECT product_id, name AS {s}_name, round(text_sim, 6) AS {s}_text_sim, link AS {s}_link FROM {s}b{more})"
    )


@query(
    f"WITH RECURSIVE {OFFERS}, so AS (SELECT product_id, base_price, {NAMED_OFFER} FROM lines JOIN products USING (product_id)), {_text_sql()}, {_named_side_sql('k', 0)}, {_named_side_sql('n', 1)} "
    "SELECT product_id, k_name, k_text_sim, k_link, n_name, n_text_sim, n_link FROM products LEFT JOIN k USING (product_id) LEFT JOIN n USING (product_id)"
)
def matched_by_text(spark, sf_dir):
    """The best match of each competitor where offers have names of their own: model, token, block, and number scores decide."""
    p = products(spark, sf_dir)
    own = p.select(F.col("product_id").alias("ordinal"), F.concat(F.col("p_name"), F.lit(" TS-"), F.col("product_id").cast("string"), F.lit("C 세트")).alias("product_name"), "base_qty", "base_price", F.lit("base.jpg").alias("base_image"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("ordinal")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    offers = spark.sql(f"SELECT product_id, {NAMED_OFFER} FROM {{sides}}", sides=lines.join(p, "product_id"))
    out = own.select(F.col("ordinal").alias("product_id"))
    for s, rest in (("k", 0), ("n", 1)):
        found = compare.with_text(matching.with_images(compare.candidates(own, offers.filter(F.col("ordinal") % 2 == rest))), "model_sim").withColumn("text_sim", F.round("text_sim", 12))
        best = matching.best_match(found, s, by_hash=False)
        out = out.join(best.select("product_id", F.col("name").alias(f"{s}_name"), F.round("text_sim", 6).alias(f"{s}_text_sim"), F.col("link").alias(f"{s}_link")), "product_id", "left")
    return out
