"""Queries over cells, pages and files as they come in, each with SQL that says what must come out.

Cells and pages are made of the tables' columns by expressions that both engines read alike; the library takes them apart again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import schema as S
from .. import sinks
from ..functions import literals as L
from ..operators import filters, images, joins
from ..sources import readers, tier_function
from .registry import COMPARISON, comparison, query, spread, table


def made(template: str, **columns: str) -> str:
    """SQL for ``template`` with quotes, backslashes and ``<name>`` parts; engines differ in how they escape, so these go by their codes."""
    out = "".join(f"' || chr({ord(c)}) || '" if c in "'\\" else c for c in template)
    for name, sql in columns.items():
        out = out.replace(f"<{name}>", f"' || {sql} || '")
    return f"('{out}')"


# ---------------------------------------------------------------- literal cells
WORD = "split_part(p_name, ' ', 1)"
CELL = (
    f"CASE p_partkey % 5 WHEN 0 THEN {made("""{'url': 'http://h/<k>', 'name': "<w>'s", 'n': None, 300: 4.5, 'deep': {'a': [1, (2, <k>),], 'ok': True}}""", k='p_partkey', w=WORD)} "
    f"WHEN 1 THEN {made("""{'url': 'http://h/<k>', 'name': 'say "<w>", O\\'Neil: {None}', 'n': 7, 300: <k>, 'deep': {'a': [], 'ok': False}}""", k='p_partkey', w=WORD)} "
    f"WHEN 2 THEN {made("""{'url': 'http://h/<k>', 'name': '<w>""", k='p_partkey', w=WORD)} WHEN 3 THEN p_name END"
)


@query(
    f"SELECT p_partkey, p_partkey % 5 < 2 AS literal, CASE WHEN p_partkey % 5 < 2 THEN 'http://h/' || p_partkey END AS url, CASE p_partkey % 5 WHEN 0 THEN {WORD} || chr(39) || 's' WHEN 1 THEN 'say \"' || {WORD} || '\", O' || chr(39) || 'Neil: {{None}}' END AS name, "
    "CASE p_partkey % 5 WHEN 1 THEN 7::BIGINT END AS n, CASE p_partkey % 5 WHEN 0 THEN 4.5::DOUBLE WHEN 1 THEN p_partkey::DOUBLE END AS tier, CASE p_partkey % 5 WHEN 0 THEN p_partkey END AS inner_key, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS ok, "
    "CASE p_partkey % 5 WHEN 0 THEN '300,deep,n,name,url' WHEN 1 THEN '300,deep,n,name,url' END AS keys FROM part"
)
def literal_cells(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).selectExpr("p_partkey", f"{CELL} AS cell")
    rows = rows.select("p_partkey", L.literal_json(F.col("cell")).alias("j"))
    rows = rows.select("p_partkey", "j", F.try_parse_json("j").alias("v"), L.json_map(F.col("j")).alias("m"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select(
        "p_partkey", F.col("j").isNotNull().alias("literal"), F.col("m")["url"].alias("url"), F.get_json_object("j", "$.name").alias("name"), at("$.n", "long").alias("n"), at("$['300']", "double").alias("tier"),
        at("$.deep.a[1][1]", "long").alias("inner_key"), at("$.deep.ok", "boolean").alias("ok"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"),
    )


TIERS = (
    f"CASE p_partkey % 4 WHEN 0 THEN {made("{100: {'price': <p>, 'price_with_vat': None}, 300: {'price': <q>}, 'note': 'x'}", p='(1000 + p_size)', q='(900 + p_size)')} "
    f"WHEN 1 THEN {made('{\"100\": <p>, \"500\": <q>.5}', p='(1000 + p_size)', q='(900 + p_size)')} WHEN 2 THEN 'none' END"
)


@query(
    "SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [100, 300] WHEN 1 THEN [100, 500] ELSE [p_size] END)::INT AS quantity, "
    "unnest(CASE p_partkey % 4 WHEN 0 THEN [1000.0 + p_size, 900.0 + p_size] WHEN 1 THEN [1000.0 + p_size, 900.5 + p_size] ELSE [p_retailprice] END)::DOUBLE AS price FROM part"
)
def tiers_of_cells(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")).selectExpr("p_partkey", f"{TIERS} AS tiers_json", "p_size AS k_qty", "p_retailprice AS k_price")
    # a plain explode would have the cells read beforehand, to leave out rows without tiers, and that in the tasks that read the file
    return readers.tiers_of_row(rows).select("p_partkey", F.explode_outer("tiers").alias("quantity", "price")).filter("quantity is not null")


@query(
    f"WITH c AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN 'http://i/' || p_partkey || '.jpg' ELSE {CELL} END AS cell FROM part) SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN cell WHEN p_partkey % 5 < 2 THEN 'http://h/' || p_partkey END AS url, "
    "CASE WHEN p_partkey % 6 = 5 THEN 'base' END AS source FROM c"
)
def image_cells(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).selectExpr("p_partkey", f"CASE p_partkey % 6 WHEN 5 THEN 'http://i/' || p_partkey || '.jpg' ELSE {CELL} END AS cell")
    return rows.withColumn("i", images.as_image(F.col("cell"), "base")).select("p_partkey", "i.url", "i.source")


NESTED = made("{'url': 'http://in/<k>', 'n': None, 'alt': \"it's\"}", k="p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'http://in/' || p_partkey ELSE 'http://out/' || p_partkey END AS url FROM part")
def flat_images(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).selectExpr("p_partkey", f"CASE WHEN p_partkey % 2 = 0 THEN {NESTED} ELSE 'http://out/' || p_partkey END AS url")
    return rows.select("p_partkey", images.flatten_image(F.struct("url"))["url"].alias("url"))


# ---------------------------------------------------------------- pages as tables
def rows_of(*rows: tuple[str, ...]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


P1, P2 = "(1000 + p_size * 10)", "(950 + p_size * 10)"
#: A page for each detector: its table, and the quantities that come out
PAGES = {
    "by_head": (rows_of(("수량", "단가"), ("100~199", "<p>원"), ("300", "<q>")), (100, 300)),
    "by_quantity_columns": (rows_of(("", "100개", "300 EA"), ("", "<p>", "<q>")), (100, 300)),
    "by_quantity_row": (rows_of(("주문수량", "100~199", "300~"), ("판매가", "<p>", "<q>")), (100, 300)),
    "by_common_quantities": (rows_of(("x", "100", "<p>원"), ("y", "300", "<q>원")), (100, 300)),
    "by_first_columns": (rows_of(("a", "b"), ("130", "<p>원"), ("470", "<q>원")), (130, 470)),
    "by_inputs": ('<input class="a qu" value="130"><input class="pr" value="<p>"><input class="qu" value="470"><input class="pr" value="<q>">', (130, 470)),
}
HTML = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {made(page, p=P1, q=P2)}" for i, (page, _) in enumerate(PAGES.values())) + f" WHEN 6 THEN {made(PAGES['by_first_columns'][0] + PAGES['by_head'][0], p=P1, q=P2)} ELSE 'nothing here' END"
FOUND = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(PAGES)) + " WHEN 6 THEN 'by_head' END"
QUANTITIES = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN [{a}, {b}]" for i, (_, (a, b)) in enumerate(PAGES.values())) + " WHEN 6 THEN [100, 300] ELSE []::INTEGER[] END"


@query(
    f"WITH t AS (SELECT p_partkey, {FOUND} AS detector, p_partkey % 3 = 0 AS tax_excluded, unnest([0, 1]) AS tier, unnest({QUANTITIES}) AS quantity, unnest([{P1}, {P2}]) AS price FROM part) "
    "SELECT p_partkey, detector, tax_excluded, tier, quantity::BIGINT AS quantity, price::BIGINT AS price, CASE WHEN tax_excluded THEN round_even(price * 11 / 10.0, 0)::BIGINT ELSE price::BIGINT END AS price_with_tax FROM t WHERE quantity IS NOT NULL"
)
def price_tier_rows(spark, sf_dir):
    """Tiers of made pages as rows of a table function; of two tables on a page the one of the first detector counts."""
    pages = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).selectExpr("p_partkey", f"{HTML} || CASE WHEN p_partkey % 3 = 0 THEN ' 부가세 별도' ELSE '' END AS html")
    return tier_function.tier_rows(pages, "p_partkey")


# ---------------------------------------------------------------- files, samples, joins by name
TABLES = ("part", "supplier", "nation", "region")


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n FROM {t}" for t in TABLES if t != "region"))
def rows_per_file(spark, sf_dir):
    """Rows of each file of a folder that is recent enough and fits a name."""
    files = [readers.recent(table(spark, sf_dir, t), after="2000-01-01 00:00:00", least_bytes=1, name="^[a-q s-z]").groupBy("file").agg(F.count("*").alias("n")) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), files)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT < (0.2 * 4294967296)::BIGINT GROUP BY l_orderkey")
def sampled_orders(spark, sf_dir):
    return filters.sample_share(table(spark, sf_dir, "lineitem"), "l_orderkey", 20).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT p.p_partkey, p.p_name AS product_name, s.s_suppkey FROM (SELECT * FROM part WHERE p_size < 10) p LEFT JOIN (SELECT s_suppkey, p_name || '  ' AS n FROM supplier JOIN part ON p_partkey = s_suppkey) s ON trim(p.p_name) = trim(s.n)")
def offers_by_name(spark, sf_dir):
    products = spread(table(spark, sf_dir, "part").filter("p_size < 10")).select("p_partkey", F.col("p_name").alias("product_name"))
    offers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", F.concat("p_name", F.lit("  ")).alias("product_name"))
    return joins.offers_of(products, offers, trim=True)


@query("SELECT DISTINCT l_quantity::BIGINT AS quantity FROM lineitem WHERE l_quantity > 0")
def quantities_by_word(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_tax").cast("string").alias("세금"), F.concat(F.lit(" "), F.format_number("l_quantity", 1)).alias("주문 수량 (Qty)"))
    return readers.quantities_by_word(rows)


@query(
    "WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem), "
    "k AS (SELECT *, (i - 1) // 3 + 1 AS page, (i - 1) % 3 AS place FROM r) SELECT l_partkey::VARCHAR AS query, ((page - 1) * 3 + place)::INT AS ordinal, l_orderkey || '-' || l_linenumber AS title FROM k WHERE (page - 1) * 3 + place < 8"
)
def search_items(spark, sf_dir):
    """Items of landed result pages, three to a page, eight for a query."""
    w = "row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber)"
    items = table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey AS string) AS query", f"{w} - 1 AS i", "l_orderkey || '-' || l_linenumber AS title")
    pages = items.groupBy("query", F.expr("cast(i div 3 + 1 AS int)").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: F.create_map(F.lit("title"), x["title"])).alias("items"))
    return readers.search_pages(pages, max_items=8, page_size=3).select("query", F.col("ordinal").cast("int").alias("ordinal"), F.col("item")["title"].alias("title"))


# ---------------------------------------------------------------- images of offers and products
FIELDS = "CASE WHEN p_partkey % 3 = 0 THEN 'http://i/' || p_partkey || '.PNG' WHEN p_partkey % 3 = 1 THEN '' END AS image_url, CASE WHEN p_partkey % 4 = 1 THEN 'x/' || p_partkey || '.txt' END AS image_path, 'http://s/' || p_partkey || '.webp' AS src"


@query(
    f"WITH f AS (SELECT p_partkey, {FIELDS} FROM part), g AS (SELECT p_partkey, coalesce(nullif(image_url, ''), nullif(image_path, ''), nullif(src, '')) AS got FROM f) "
    "SELECT p_partkey, CASE WHEN regexp_matches(got, '(?i)\\.(jpe?g|png|gif|webp)') THEN got END AS image FROM g"
)
def offer_images(spark, sf_dir):
    rows = spark.sql(f"SELECT p_partkey, {FIELDS} FROM {{part}}", part=table(spark, sf_dir, "part"))
    return rows.select("p_partkey", images.offer_image(F.struct("image_url", "image_path", "src")).alias("image"))


ROW = (
    "p_partkey AS ordinal, CASE WHEN p_partkey % 2 = 0 THEN 'http://k/' || p_partkey END AS k_link, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS k_price, CASE WHEN p_partkey % 5 = 0 THEN 'http://b/' || p_partkey END AS base_image, "
    "CASE WHEN p_partkey % 7 = 0 THEN 'http://ki/' || p_partkey END AS k_image, CAST(NULL AS VARCHAR(9)) AS n_image"
)
MATCHED = "p_partkey AS ordinal, 'f/base_' || p_partkey AS base, CASE WHEN p_partkey % 11 > 0 THEN 'f/k_' || p_partkey END AS k, 'f/n_' || p_partkey AS n"


@query(
    f"WITH r AS (SELECT {ROW} FROM part), m AS (SELECT {MATCHED} FROM part WHERE p_size > 5) SELECT r.ordinal, coalesce(base_image, base) AS base_image, "
    "CASE WHEN k_link IS NOT NULL OR k_price IS NOT NULL THEN coalesce(k_image, k) END AS k_image, coalesce(n_image, n) AS n_image FROM r LEFT JOIN m USING (ordinal)"
)
def applied_images(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = spark.sql(f"SELECT {ROW} FROM {{part}}", part=part)
    matched = spark.sql(f"SELECT {MATCHED} FROM {{part}} WHERE p_size > 5", part=part)
    return images.apply_images(rows, matched).select("ordinal", "base_image", "k_image", "n_image")


ALIASED = "'dir' || (p_partkey % 3) || '/Kogift_' || substr(md5(p_name), 1, 12) || CASE WHEN p_partkey % 2 = 0 THEN '_nobg' ELSE '' END || '.JPG' AS path, CAST(900 + p_size * 10 AS BIGINT) AS length, CAST(p_partkey % 3 AS INT) AS rank"


@query(
    f"WITH f AS (SELECT DISTINCT {ALIASED} FROM part), g AS (SELECT *, split_part(path, '/', 2) AS name FROM f WHERE length >= 1000), "
    r"h AS (SELECT *, regexp_replace(name, '_nobg(\.[^.]*)$', '\1') AS plain FROM g), a AS (SELECT path, rank, unnest(list_distinct([name, lower(name), regexp_replace(name, '^[a-z]+_', ''), regexp_extract(name, '([0-9a-fA-F]{8,})', 1), plain, regexp_replace(plain, '(\.[^.]*)$', '_nobg\1')])) AS alias FROM h) "
    "SELECT alias, max_by(path, (rank, path)) AS path FROM a WHERE alias <> '' GROUP BY alias"
)
def file_aliases(spark, sf_dir):
    files = spark.sql(f"SELECT DISTINCT {ALIASED} FROM {{part}}", part=table(spark, sf_dir, "part"))
    return images.image_aliases(files)


@query("SELECT DISTINCT p_partkey, 'f/' || p_size AS path FROM part WHERE p_size % 3 > 0")
def verified_matches(spark, sf_dir):
    scored = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN IF(p_size % 2 = 0, NULL, '') ELSE 'f/' || p_size END AS path", "0.1 AS score")
    return images.verified_images(scored.union(scored), "p_partkey", "path")


# ---------------------------------------------------------------- both output tables of one pass
@query(
    f"WITH {COMPARISON}, t AS (SELECT 'result' AS table, p_partkey::VARCHAR AS code, CASE WHEN k_diff IS NULL THEN '-' ELSE 'k' END AS k, NULL::VARCHAR AS price FROM c UNION ALL "
    "SELECT 'upload', p_partkey::VARCHAR, CASE WHEN k_diff IS NULL THEN '' ELSE 'k' END, k_price::BIGINT::VARCHAR FROM c WHERE k_diff < -1) SELECT * FROM t"
)
def both_outputs(spark, sf_dir):
    """Rows of result and upload as they are written: the upload's only where k undercuts, with its price as text."""
    c = comparison(spark, sf_dir).withColumn("code", F.col("p_partkey").cast("string"))
    both = sinks.both_tables(c, upload=F.col("k_diff") < -1)
    r, u = (list(x) for x in (S.RESULT_COLUMNS, S.UPLOAD_COLUMNS))
    result = F.col("table") == "result"
    cell = lambda name: F.when(result, F.col(f"r{r.index(name)}")).otherwise(F.col(f"u{u.index(name)}"))
    mark = F.when(cell("k_diff").isin("-", ""), cell("k_diff")).otherwise("k")
    return both.select("table", cell("code").alias("code"), mark.alias("k"), F.when(~result, cell("k_price")).alias("price"))
