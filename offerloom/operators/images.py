"""Image columns: choosing files, addresses for the outputs, and gates on image data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import literals as L
from ..functions import text as T
from . import joins


def image_metadata(files: DataFrame, prefer_original: bool = True, prefer_jpg: bool = True) -> DataFrame:
    """``base_name, path, product_hash, is_original, extension``: one file of each stem without ``_nobg``.

    Preference goes by original against cut-out and by jpg against any other type, the first named first; ties by path.
    """
    f = files.filter(F.lower("path").rlike(r"\.(jpe?g|png|gif)$"))
    stem = T.file_stem(F.col("path"))
    f = f.select("path", F.regexp_replace(stem, "_nobg$", "").alias("base_name"), (~stem.endswith("_nobg")).alias("is_original"), F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).alias("extension"))
    right = F.col("is_original") == F.lit(prefer_original)
    kind = F.col("extension").isin(".jpg", ".jpeg") == F.lit(prefer_jpg)
    row = F.struct("path", "is_original", "extension")
    got = f.groupBy("base_name").agg(F.min_by(row, F.struct(~right, ~kind, F.col("path"))).alias("r")).select("base_name", "r.*")
    return got.withColumn("product_hash", T.file_hash(F.concat(F.col("base_name"), F.lit(".jpg"))))


def image_aliases(files: DataFrame) -> DataFrame:
    """``alias, path``: the names a file may be asked for by; of files of 1000 bytes at least, and the last folder wins."""
    f = files.filter("length >= 1000").select("path", "rank", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"))
    stem = T.file_stem(F.col("name"))
    bare = F.regexp_replace(F.col("name"), "^[a-z]+_", "")
    plain = F.regexp_replace(F.col("name"), r"_nobg(\.[^.]*)$", "$1")
    names = F.array_distinct(F.array("name", F.lower("name"), bare, F.regexp_extract(stem, "([0-9a-fA-F]{8,})", 1), plain, F.regexp_replace(plain, r"(\.[^.]*)$", "_nobg$1")))
    f = f.select("path", "rank", F.explode(F.filter(names, lambda x: x != "")).alias("alias"))
    return f.groupBy("alias").agg(F.max_by("path", F.struct("rank", "path")).alias("path"))


def as_image(value: Column, source: str) -> Column:
    """An image struct of an address or of a struct's text, as JSON or a Python literal; null for anything else."""
    parsed = L.let(F.from_json(L.literal_json(value), S.IMAGE), lambda image: F.when(T.is_http(image["url"]), image))
    plain = F.struct(*[(value if f.name == "url" else F.lit(source) if f.name == "source" else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.IMAGE.fields])
    return F.when(T.is_http(value), plain).when(value.startswith("{"), parsed)


def first_field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The column of the first of ``names`` that a frame has, else null: which fields a record has decides, not whether they hold something."""
    there = [c for c in names if c in df.columns]
    return F.col(there[0]) if there else F.lit(None).cast("string")


# Fields of a shopping offer that may hold the seller's name and link, in the order they are tried.
SELLER_NAMES = ("mall_name", "mallName", "seller_name", "api_seller_name")
SELLER_LINKS = ("mall_link", "mallProductUrl", "seller_link")


def with_seller(offers: DataFrame) -> DataFrame:
    """``offers`` with ``n_supplier`` and ``n_supplier_link``, each from the first field that a record's map ``fields`` has, or else from columns."""
    if "fields" in offers.columns:
        pick = lambda names: F.coalesce(*[F.when(F.map_contains_key("fields", c), F.struct(F.col("fields")[c].alias("v"))) for c in names])["v"]
    else:
        pick = lambda names: first_field(offers, names)
    return offers.withColumns({"n_supplier": pick(SELLER_NAMES), "n_supplier_link": pick(SELLER_LINKS)})


def normalised_candidates(offers: DataFrame) -> DataFrame:
    """Offers with a name and a link or address (``href``), which then is the link; any price will do. ``image_path`` gives way to ``src``, then ``image_url``."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if c in offers.columns else F.lit(None).cast("string")
    out = offers.withColumns({"link": F.coalesce(blank("link"), blank("href")), "image_path": F.coalesce(blank("image_path"), blank("src"), blank("image_url"))})
    return out.filter((F.coalesce(F.col("name"), F.lit("")) != "") & F.col("link").isNotNull())


def product_codes(html: Column) -> Column:
    """Catalogue codes (four letters and digits) in the addresses of a page's product images, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)/upload/product/\w+/([A-Z]{4}\d+)s"), 1)


def product_images(html: Column) -> Column:
    """The addresses of a page's product images, in order."""
    return F.regexp_extract_all(html, F.lit(r"<img[^>]+src=[\"']([^\"']*upload/product[^\"']*\.(?:jpe?g|png|gif|webp))[\"']"), 1)


# Parts of addresses that no product image has.
NOT_PRODUCT = ("icon", "button", "btn_", "pixel.gif", "spacer.gif", "no_image", "_s.")


def valid_product_image(url: Column, host: str) -> Column:
    """Whether an address, absolute on ``host`` or from the root, is that of a product image."""
    u = F.lower(F.trim(url))
    path = F.when(u.startswith("http"), T.url_path(u)).otherwise(F.regexp_replace(u, r"[?#].*$", ""))
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    sound = u.rlike("^(https?://|/)") & ext.isin("", ".jpg", ".jpeg", ".png", ".gif") & ~T.contains_any(u, NOT_PRODUCT)
    return F.coalesce(sound & (~u.startswith("http") | T.url_host(u).contains(host)), F.lit(False))


def offer_image(offer: Column) -> Column:
    """An offer's image: the first of its fields that has one; only addresses with a known image extension count."""
    got = F.coalesce(*[F.nullif(offer[f], F.lit("")) for f in ("image_url", "image_path", "src")])
    return F.when(got.rlike(r"(?i)\.(jpe?g|png|gif|webp)"), got)


def flatten_image(image: Column) -> Column:
    """An address nested in an address is lifted: a struct's text within ``url`` gives its own ``url``."""
    inner = F.get_json_object(L.literal_json(image["url"]), "$.url")
    return F.when(image["url"].startswith("{"), image.withField("url", inner)).otherwise(image)


def result_url(image: Column, code_template: str = "", id_template: str = "") -> Column:
    """The first http address of an image; else one built from a product code of four letters and seven digits, or from its product id."""
    first = F.coalesce(*[F.when(T.is_http(image[f]), image[f]) for f in ("url", "product_page_url", "original_crawled_url", "original_url")])
    code = F.nullif(F.regexp_extract(F.coalesce(image["original_path"], image["local_path"], F.lit("")), r"([A-Z]{4}\d{7})", 1), F.lit(""))
    pid = F.nullif(image["product_id"], F.lit(""))
    pid = F.when(pid.contains("_"), pid).otherwise(F.concat(pid, F.lit("_0")))
    made = [F.replace(F.lit(t), F.lit("{}"), x) for t, x in ((code_template, code), (id_template, pid)) if t]
    return F.coalesce(first, *made, F.lit(None).cast("string"))


def market_upload_url(url: Column, original: Column, host: str) -> Column:
    """Addresses on the image host stay; a placeholder gives way to the original's if that is on the host; else empty."""
    on = lambda c: F.coalesce(c.contains(host), F.lit(False))
    return F.when(on(url), url).when(on(original), original).otherwise("")


def unreliable_url(url: Column, marker: str = "front/") -> Column:
    return F.coalesce(F.lower(url).contains(marker), F.lit(False))


def drop_unreliable(image: Column, marker: str = "front/") -> Column:
    """An unreliable address is blanked if there is a local file; without one the image goes."""
    bad = unreliable_url(image["url"], marker)
    has = F.coalesce(image["local_path"] != "", F.lit(False))
    return F.when(bad & ~has, F.lit(None)).when(bad, image.withField("url", F.lit(""))).otherwise(image)


def direct_image(url: Column, host: str) -> Column:
    return F.coalesce(url.contains(host) & url.rlike(r"(?i)\.(jpe?g|png)$"), F.lit(False))


def promo_upload_url(image: Column, link: Column, host: str, template: str) -> Column:
    """The promotional competitor's address for the upload: made of the image's product id, or of the link's; else a direct image address; else the link."""
    pid = F.coalesce(F.nullif(image["product_id"], F.lit("")), T.query_value(link, "no", "product_id"))
    pid = F.when(pid.contains("_"), pid).otherwise(F.concat(pid, F.lit("_0")))
    direct = [F.when(direct_image(image[f], host), image[f]) for f in ("original_crawled_url", "original_url", "url")]
    return F.coalesce(F.replace(F.lit(template), F.lit("{}"), pid), *direct, F.when(T.is_http(link), link), F.lit(""))


def link_as_image(image: Column, link: Column) -> Column:
    return F.when(T.is_http(link), image.withField("url", link)).otherwise(image)


def improved_promo_image(image: Column, link: Column, template: str) -> Column:
    """A valid address stays; else the originals', else one made of the link's product code, else the link."""
    sound = lambda c: F.when(T.is_http(c) & ~c.contains("placeholder"), c)
    code = F.coalesce(T.query_value(link, "goodsno", "goodsNo", "no"), F.nullif(F.regexp_extract(link, r"/goods/(\w+)", 1), F.lit("")))
    url = F.coalesce(sound(image["url"]), sound(image["original_url"]), sound(image["original_crawled_url"]), F.replace(F.lit(template), F.lit("{}"), code), sound(link))
    return image.withField("url", url)


def supplier_of_link(link: Column, known: dict[str, str]) -> Column:
    """A known host's label, else the first label of the host, ``unknown`` without a link."""
    host = F.regexp_replace(T.url_host(link), "^www\\.", "")
    out = F.when(host == "", "unknown").otherwise(F.substring_index(host, ".", 1))
    for h, label in known.items():
        out = F.when(host.contains(h), label).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def supplier_type(seller: Column) -> Column:
    """The kind of shop by words in the seller's name, the first that fits."""
    out = None
    for words, label in S.SUPPLIER_TYPES:
        test = T.contains_any(seller, words, fold=False)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(S.SUPPLIER_OTHER)


def apply_images(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """``rows`` with images of ``matched(ordinal, base, k, n)``: a k image only where there is a k link or price; an address of the row goes before the file's."""
    got = rows.join(matched.select("ordinal", *[F.col(s).alias(f"__{s}") for s in ("base", "k", "n")]), "ordinal", "left")
    gate = F.coalesce("k_link", F.col("k_price").cast("string")).isNotNull()
    pick = {"base_image": F.coalesce("base_image", "__base"), "k_image": F.when(gate, F.coalesce("k_image", "__k")), "n_image": F.coalesce("n_image", "__n")}
    return got.withColumns(pick).drop("__base", "__k", "__n")


def verified_images(scored: DataFrame, left_id: str, right_path: str) -> DataFrame:
    """Matches whose file exists; the scores recomputed on the way decide nothing."""
    return scored.filter(F.col(right_path).isNotNull() & (F.col(right_path) != "")).select(left_id, right_path).distinct()


def base_image_lookup(rows: DataFrame, images: DataFrame) -> DataFrame:
    """``rows`` with the http address found by code, else by name."""
    return joins.lookup_twice(rows, images.filter(T.is_http(F.col("url"))), "code", "product_name", "key", "url")
