"""Named queries over the comparison's cells: clears, row filters, images, and the layouts that are written, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .. import sinks
from ..functions import nulls as N
from ..operators import filters, images, joins
from .registry import COMPARISON, comparison, query, table

#: Cells made of the key, read alike by Spark and DuckDB
MORE = {
    "n_image": "CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'http://img/' || p_partkey || '.jpg' END",
    "k_image": "CASE p_partkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN NULL ELSE 'http://k/' || p_partkey END",
    "n_supplier": "CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN 'shop ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' 기프트' ELSE '' END END",
    "quality": "CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'rejected' WHEN 2 THEN 'low' END",
}
CELLS = f"{COMPARISON}, m AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in MORE.items())} FROM c)"
K = ("k_qty", "k_price", "k_diff", "k_diff_pct", "k_link")
NS = ("n_qty", "n_price", "n_diff", "n_diff_pct", "n_supplier", "n_link")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).selectExpr("*", *[f"{v} AS {k}" for k, v in MORE.items()])


def _when(condition: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN NOT coalesce({condition}, false) THEN {c} END AS {c}" for c in columns)


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(like.schema[c].dataType) for c in df.columns if c in like.columns and df.schema[c].dataType != like.schema[c].dataType})


@query(f"WITH {COMPARISON} SELECT p_partkey, format('{{:,.0f}}', k_diff) AS k_diff, k_diff_pct || ' %' AS k_diff_pct, format('{{:,.0f}}', n_diff) AS n_diff, n_diff_pct || ' %' AS n_diff_pct FROM c")
def rendered_differences(spark, sf_dir):
    return filters.rendered_differences(comparison(spark, sf_dir)).select("p_partkey", "k_diff", "k_diff_pct", "n_diff", "n_diff_pct")


@query(f"WITH {CELLS} SELECT p_partkey, quality FROM m WHERE abs(k_diff / base_price) <= 0.9::DOUBLE AND abs(n_diff / base_price) <= 0.9::DOUBLE AND quality IN ('high', 'medium', 'low')")
def filter_results(spark, sf_dir):
    c = cells(spark, sf_dir).withColumns({f"{s}_diff_ratio": F.col(f"{s}_diff") / F.col("base_price") for s in "kn"})
    return filters.filter_results(c, most=0.9).select("p_partkey", "quality")


@query(f"WITH {COMPARISON}, u AS (SELECT p_partkey, coalesce(k_diff < -1000000, false) OR coalesce(n_diff < -1000000, false) AS keep FROM c) SELECT p_partkey FROM u WHERE keep UNION ALL (SELECT p_partkey FROM u WHERE NOT keep AND (SELECT count(*) FILTER (keep) < count(*) * 0.1 AND count(*) > 5 FROM u) ORDER BY p_partkey LIMIT 5)")
def upload_add_back(spark, sf_dir):
    """So few rows stay that the first five of the others come back."""
    return filters.upload_rows(comparison(spark, sf_dir), "p_partkey", threshold=-1_000_000.0).select("p_partkey")


@query(
    f"WITH {CELLS}, x AS (SELECT *, n_image IS NULL OR trim(n_image) IN ('', '-') AS missing, coalesce(n_qty <> 0, false) OR coalesce(n_price <> 0, false) OR coalesce(n_diff <> 0, false) OR n_diff_pct IS NOT NULL OR coalesce(n_supplier NOT IN ('-', ''), false) OR n_link IS NOT NULL AS some_data FROM m) "
    f"SELECT p_partkey, {_when('missing', NS)}, CASE WHEN missing OR some_data THEN n_image END AS n_image FROM x"
)
def clean_market_data(spark, sf_dir):
    return filters.clean_market_data(cells(spark, sf_dir)).select("p_partkey", *NS, "n_image")


@query(f"WITH {CELLS} SELECT p_partkey, {_when("k_image IS NULL OR k_image IN ('', '-', 'nan', 'NaN', 'none', 'None')", K)} FROM m")
def clear_without_k_image(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _typed(filters.clear_without_k_image(c), c).select("p_partkey", *K)


@query(
    f"WITH {CELLS}, f AS (SELECT * FROM m WHERE coalesce(k_diff < 0, false) OR coalesce(n_diff < 0, false)), g AS (SELECT *, coalesce(k_diff >= 0, false) OR coalesce(k_diff_pct > -1, false) AS kg, "
    f"coalesce(n_diff >= 0, false) OR coalesce(n_diff_pct > -1, false) OR ((n_qty IS NULL OR n_qty = 0) AND coalesce(n_diff_pct > -10, false) AND NOT coalesce({' OR '.join(f"contains(n_supplier, '{w}')" for w in S.PROMO_UPLOAD)}, false)) AS ng FROM f), "
    f"h AS (SELECT p_partkey, {_when('kg', (*K, 'k_image'))}, {_when("ng OR n_supplier = '-'", ('n_supplier',))}, {_when('ng', tuple(c for c in (*NS, 'n_image') if c != 'n_supplier'))} FROM g) "
    "SELECT * FROM h WHERE k_qty IS NOT NULL OR k_price IS NOT NULL OR k_diff IS NOT NULL OR k_diff_pct IS NOT NULL OR k_link IS NOT NULL OR n_qty IS NOT NULL OR n_price IS NOT NULL OR n_diff IS NOT NULL OR n_diff_pct IS NOT NULL OR coalesce(trim(n_supplier) <> '', false) OR n_link IS NOT NULL"
)
def legacy_upload(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _typed(filters.legacy_upload(c), c).select("p_partkey", *K, "k_image", *NS, "n_image")


@query("SELECT p_partkey, p_name FROM part WHERE (p_name IS NOT NULL AND p_name <> '' AND p_size > 20) OR p_size % 7 = 0")
def lookable(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 20, F.col("p_name")).alias("product_name"), F.when(F.col("p_size") % 7 == 0, F.col("p_size")).alias("code"))
    return filters.lookable(p).select("p_partkey", "p_name")


# ---------------------------------------------------------------- image cells
PARTS = {
    "url": "CASE p_partkey % 7 WHEN 0 THEN 'http://shop.pstatic.example/front/' || p_partkey WHEN 1 THEN '' WHEN 2 THEN 'https://shop.pstatic.example/main/' || p_partkey || '.jpg' WHEN 3 THEN 'http://placeholder/x' WHEN 4 THEN '/local/x.jpg' WHEN 5 THEN 'https://koreagift.example/a.png' END",
    "local_path": "CASE p_partkey % 3 WHEN 0 THEN '/img/ABCD1234567_x.jpg' WHEN 1 THEN '' END",
    "original_path": "CASE p_partkey % 4 WHEN 0 THEN 'http://orig/WXYZ7654321.png' WHEN 1 THEN '/o/WXYZ7654321.png' END",
    "original_url": "CASE p_partkey % 5 WHEN 0 THEN 'http://shop.pstatic.example/o' || p_partkey WHEN 1 THEN 'https://koreagift.example/b.jpeg' WHEN 2 THEN '' END",
    "original_crawled_url": "CASE p_partkey % 6 WHEN 0 THEN 'http://crawled/c.gif' WHEN 1 THEN 'https://koreagift.example/c.jpg' END",
    "source": "CASE p_partkey % 2 WHEN 0 THEN 'naver' ELSE 'kogift' END",
    "product_name": "p_name",
    "similarity": "CASE p_partkey % 6 WHEN 0 THEN NULL ELSE CAST(p_size % 10 AS DOUBLE) / CAST(10 AS DOUBLE) END",
    "product_id": "CASE p_partkey % 8 WHEN 0 THEN 'p_' || p_partkey WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN '' END",
    "product_page_url": "CASE p_partkey % 9 WHEN 0 THEN 'https://page/' || p_partkey END",
}
LINK = "CASE p_partkey % 5 WHEN 0 THEN 'http://koreagift.example/ez/goods.php?no=' || p_partkey WHEN 1 THEN 'http://x/goods/A' || p_partkey || '/v' WHEN 2 THEN 'none' WHEN 3 THEN 'https://x/?product_id=77_1' END"
IMAGED = f"i AS (SELECT p_partkey, p_size, {', '.join(f'{v} AS {k}' for k, v in PARTS.items())}, {LINK} AS link FROM part)"
HTTP = "coalesce(regexp_matches({}, '^https?://'), false)"
ON = "coalesce(contains({0}, 'koreagift.example') AND regexp_matches(lower({0}), '\\.(jpe?g|png)$'), false)"


def imaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", *[f"{v} AS {k}" for k, v in PARTS.items()], f"{LINK} AS link")
    return flat.select("p_partkey", "p_size", "link", F.struct(*PARTS).alias("image"))


def _pid(found: str) -> str:
    return f"CASE WHEN contains({found}, '_') THEN {found} ELSE {found} || '_0' END"


_LINK_ID = "coalesce(nullif(regexp_extract(link, '[?&]no=([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(link, '[?&]product_id=([A-Za-z0-9_-]+)', 1), ''))"
_PROMO = f"coalesce(nullif(product_id, ''), {_LINK_ID})"
_CODE = "nullif(regexp_extract(coalesce(original_path, local_path, ''), '([A-Z]{4}[0-9]{7})', 1), '')"
_SOUND = lambda c: f"CASE WHEN {HTTP.format(c)} AND NOT contains({c}, 'placeholder') THEN {c} END"
_LINK_CODE = "coalesce(nullif(regexp_extract(link, '[?&]no=([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(link, '/goods/([A-Za-z0-9_]+)', 1), ''))"


@query(
    f"WITH {IMAGED} SELECT p_partkey, coalesce({', '.join(f'CASE WHEN {HTTP.format(c)} THEN {c} END' for c in ('url', 'product_page_url', 'original_crawled_url', 'original_url'))}, 'https://made/' || {_CODE}, 'https://id/' || {_pid("nullif(product_id, '')")}) AS result_url, "
    "CASE WHEN coalesce(contains(url, 'pstatic'), false) THEN url WHEN coalesce(contains(original_url, 'pstatic'), false) THEN original_url ELSE '' END AS market_url, "
    f"coalesce('https://t/' || {_pid(_PROMO)}, {', '.join(f'CASE WHEN {ON.format(c)} THEN {c} END' for c in ('original_crawled_url', 'original_url', 'url'))}, CASE WHEN {HTTP.format('link')} THEN link END, '') AS promo_url, "
    f"CASE WHEN {HTTP.format('link')} THEN link ELSE url END AS linked, CASE WHEN coalesce(contains(lower(url), 'front/'), false) AND NOT coalesce(local_path <> '', false) THEN 'gone' WHEN coalesce(contains(lower(url), 'front/'), false) THEN '' ELSE url END AS reliable, "
    f"coalesce({_SOUND('url')}, {_SOUND('original_url')}, {_SOUND('original_crawled_url')}, 'https://g/' || {_LINK_CODE}, {_SOUND('link')}) AS improved FROM i"
)
def image_columns(spark, sf_dir):
    """The addresses that the outputs write of an image."""
    i, link = F.col("image"), F.col("link")
    reliable = images.drop_unreliable(i)
    return imaged(spark, sf_dir).select(
        "p_partkey", images.result_url(i, "https://made/{}", "https://id/{}").alias("result_url"), images.market_upload_url(i["url"], i["original_url"], "pstatic").alias("market_url"),
        images.promo_upload_url(i, link, "koreagift.example", "https://t/{}").alias("promo_url"), images.link_as_image(i, link)["url"].alias("linked"),
        F.when(reliable.isNull(), "gone").otherwise(reliable["url"]).alias("reliable"), images.improved_promo_image(i, link, "https://g/{}")["url"].alias("improved"),
    )


@query(
    f"WITH {IMAGED}, x AS (SELECT *, coalesce(similarity, 0) < 0.7::DOUBLE AS low_n, coalesce(similarity, 0) < 0.65::DOUBLE AS low_k FROM i) SELECT p_partkey, low_n AS no_n_image, CASE WHEN NOT low_n THEN p_size END AS n_price, low_k AS no_k_image, CASE WHEN NOT low_k THEN p_size END AS k_price, "
    "CASE WHEN coalesce(contains(lower(url), 'front/'), false) THEN '' ELSE url END AS front_url, CASE WHEN coalesce(contains(lower(url), 'front/'), false) THEN url ELSE original_url END AS front_original, "
    f"coalesce(nullif(url, ''), nullif(original_url, ''), CASE WHEN {HTTP.format('original_path')} THEN original_path END, 'https://m/' || nullif(product_id, '')) AS complete_url, "
    f"coalesce(nullif(url, ''), nullif(original_url, ''), CASE WHEN {HTTP.format('original_path')} THEN original_path END, 'https://m/' || nullif(product_id, ''), nullif(local_path, '')) IS NULL AS complete_gone, "
    "CASE WHEN NOT ((url IS NULL OR url IN ('', '-', 'None', 'nan')) AND (local_path IS NULL OR local_path IN ('', '-', 'None', 'nan'))) THEN p_size END AS strict_price FROM x"
)
def image_filters(spark, sf_dir):
    """Images too unlike the base image, fronts of unreliable addresses, images made complete, and groups without image."""
    rows = imaged(spark, sf_dir).withColumns({"n_image": F.col("image"), "k_image": F.col("image"), "n_price": F.col("p_size"), "k_price": F.col("p_size")})
    keys = lambda df, *c: df.select("p_partkey", *c)
    like = keys(filters.filter_images(rows), F.col("n_image").isNull().alias("no_n_image"), F.col("n_price").cast("int").alias("n_price"), F.col("k_image").isNull().alias("no_k_image"), F.col("k_price").cast("int").alias("k_price"))
    front = keys(filters.replace_front_urls(rows), F.col("n_image.url").alias("front_url"), F.col("n_image.original_url").alias("front_original"))
    full = keys(filters.complete_market_image(rows, "https://m/{id}"), F.col("n_image.url").alias("complete_url"), F.col("n_image").isNull().alias("complete_gone"))
    strict = keys(filters.clear_market_without_image(rows, strict=True), F.col("n_price").cast("int").alias("strict_price"))
    return like.join(front, "p_partkey").join(full, "p_partkey").join(strict, "p_partkey")


@query(f"WITH {COMPARISON} SELECT p_partkey, {_when("n_link IS NULL OR p_partkey % 3 = 0", ('n_qty', 'n_price'))} FROM c")
def market_without_link(spark, sf_dir):
    c = comparison(spark, sf_dir).withColumn("n_link", F.when(F.col("p_partkey") % 3 != 0, F.col("n_link")).otherwise("nan"))
    return _typed(filters.clear_market_without_link(c, strict=True), c).select("p_partkey", "n_qty", "n_price")


# ---------------------------------------------------------------- offers as they arrive
@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN p_name || '!' END AS n_supplier, CASE p_partkey % 4 WHEN 0 THEN 'm' || p_partkey WHEN 1 THEN NULL WHEN 2 THEN 's' || p_partkey END AS n_supplier_link FROM part"
)
def seller_fallbacks(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.create_map(F.lit("mall_name"), "p_name", F.lit("mallName"), F.lit("no"))).when(k % 5 == 1, F.create_map(F.lit("mallName"), "p_brand")).when(k % 5 == 2, F.create_map(F.lit("seller_name"), "p_type"))
    name = name.when(k % 5 == 3, F.create_map(F.lit("api_seller_name"), F.concat("p_name", F.lit("!")))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    at = lambda c: F.concat(F.lit(c), k.cast("string"))
    link = F.when(k % 4 == 0, F.create_map(F.lit("mall_link"), at("m"), F.lit("seller_link"), at("s"))).when(k % 4 == 1, F.create_map(F.lit("mallProductUrl"), F.lit(None).cast("string"), F.lit("seller_link"), at("s")))
    link = link.when(k % 4 == 2, F.create_map(F.lit("seller_link"), at("s"))).otherwise(F.create_map(F.lit("nothing"), F.lit("x")))
    rows = table(spark, sf_dir, "part").withColumn("fields", F.map_concat(name, link))
    return images.with_seller(rows).select("p_partkey", "n_supplier", "n_supplier_link")


CANDIDATE = {
    "name": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END", "link": "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://l/' || p_partkey END", "href": "CASE p_partkey % 5 WHEN 0 THEN NULL ELSE 'http://h/' || p_partkey END",
    "image_path": "CASE p_partkey % 2 WHEN 0 THEN '' END", "src": "CASE p_partkey % 3 WHEN 0 THEN 's' || p_partkey END", "image_url": "'u' || p_partkey",
}


@query(f"WITH o AS (SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in CANDIDATE.items())} FROM part), n AS (SELECT p_partkey, name, coalesce(nullif(link, ''), nullif(href, '')) AS link, coalesce(nullif(image_path, ''), nullif(src, ''), nullif(image_url, '')) AS image_path FROM o) SELECT * FROM n WHERE coalesce(name, '') <> '' AND link IS NOT NULL")
def normalised_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{v} AS {k}" for k, v in CANDIDATE.items()])
    return images.normalised_candidates(o).select("p_partkey", "name", "link", "image_path")


PAGE = "'<p><img class=x src=\"/upload/product/simple/ABCD' || page_id || 's.jpg\"><img src=''http://jclgift.example/upload/product/big/wxyz' || page_id || 's.png''><img src=\"/x/icon.gif\">'"
PAGE_SPARK = "concat('<p><img class=x src=\"/upload/product/simple/ABCD', page_id, 's.jpg\"><img src=', chr(39), 'http://jclgift.example/upload/product/big/wxyz', page_id, 's.png', chr(39), '><img src=\"/x/icon.gif\">')"


@query(
    f"WITH p AS (SELECT page_id, {PAGE} AS h FROM pages) SELECT page_id, array_to_string(regexp_extract_all(h, '(?i)/upload/product/\\w+/([A-Z]{{4}}\\d+)s', 1), ',') AS codes, array_to_string(regexp_extract_all(h, '<img[^>]+src=[\"'']([^\"'']*upload/product[^\"'']*\\.(?:jpe?g|png|gif|webp))[\"'']', 1), ',') AS found, page_id % 5 IN (0, 2) AS valid FROM p"
)
def page_images(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"{PAGE_SPARK} AS h")
    u = F.when(F.col("page_id") % 5 == 0, "/a/b.JPG?x").when(F.col("page_id") % 5 == 1, "http://other.example/a.jpg").when(F.col("page_id") % 5 == 2, " https://www.jclgift.example/a/b ").when(F.col("page_id") % 5 == 3, "/a/btn_x.gif")
    return p.select("page_id", F.array_join(images.product_codes(F.col("h")), ",").alias("codes"), F.array_join(images.product_images(F.col("h")), ",").alias("found"), images.valid_product_image(u, "jclgift.example").alias("valid"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def stripped(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit("\n")).alias("p_name"), F.concat("p_brand", F.lit("  ")).alias("p_brand"))
    return N.stripped(p)


@query(f"WITH {IMAGED} SELECT p_partkey, CASE WHEN {HTTP.format('url')} THEN url END AS found FROM i")
def base_image_lookup(spark, sf_dir):
    """Images by code, those with an http address."""
    i = imaged(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.col("image.url").alias("url"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".0")).alias("code"), F.lit("none").alias("product_name"))
    return images.base_image_lookup(rows, i).select("p_partkey", F.col("url").alias("found"))


LOCAL = "CASE p_partkey % 5 WHEN 0 THEN 'http://h/a/IMG' || p_partkey || '.jpg' WHEN 1 THEN 'http://h/a/Img' || p_partkey || '.JPG' WHEN 2 THEN 'http://h/a/pic' || p_partkey || '.png' WHEN 3 THEN 'http://h/z' || p_partkey ELSE 'http://h/nothing' || p_partkey || '.gif' END"
FILE = "CASE p_partkey % 5 WHEN 0 THEN 'IMG' || p_partkey || '.jpg' WHEN 1 THEN 'img' || p_partkey || '.jpg' WHEN 2 THEN 'pic' || p_partkey || '_nobg.png' WHEN 3 THEN 'k_' || substr(md5('http://h/z' || p_partkey), 1, 10) || '.jpg' ELSE 'other' || p_partkey || '.gif' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN {FILE} END AS local FROM part")
def local_images(spark, sf_dir):
    """Files found for addresses by name, in lower case, by stem, and by digest."""
    p = table(spark, sf_dir, "part")
    urls, files = p.selectExpr("p_partkey", f"{LOCAL} AS url"), p.selectExpr(f"{FILE} AS name")
    return joins.local_images(urls, files).select("p_partkey", "local")


# ---------------------------------------------------------------- layouts
def _plain(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN {c}::DECIMAL(38, 0)::VARCHAR ELSE {c}::VARCHAR END"


def _layout(columns: dict[str, str], empty: str, made: tuple[str, ...]) -> str:
    out = []
    for c, name in columns.items():
        if c in S.IMAGES:
            out.append(f"{'NULL' if empty == '-' else repr('')} AS \"{name}\"")
        elif c not in made:
            out.append(f"'{empty}' AS \"{name}\"")
        else:
            out.append(f"coalesce({_plain(c) if c.endswith(('price', 'diff')) else f'{c}::VARCHAR'}, '{empty}') AS \"{name}\"")
    return ", ".join(out)


MADE = ("code", "base_qty", "base_price", *K, "n_qty", "n_price", "n_diff", "n_diff_pct", "n_link")


@query(f"WITH {COMPARISON}, d AS (SELECT *, 'C' || p_partkey AS code FROM c) SELECT {_layout(S.RESULT_COLUMNS, '-', MADE)} FROM d")
def result_layout(spark, sf_dir):
    """The full result under its external names, with placeholders."""
    c = comparison(spark, sf_dir).withColumn("code", F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    return sinks.result_table(c)


@query(f"WITH {COMPARISON}, d AS (SELECT *, 'C' || p_partkey AS code FROM c) SELECT {_layout(S.UPLOAD_COLUMNS, '', MADE)} FROM d")
def upload_layout(spark, sf_dir):
    """The reduced layout for the upload, empty cells as empty text."""
    c = comparison(spark, sf_dir).withColumn("code", F.concat(F.lit("C"), F.col("p_partkey").cast("string")))
    return sinks.upload_table(c)
