"""Names, keywords, numbers and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    """The pieces between white space, none of them empty."""
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def name_hash(name: Column) -> Column:
    """16 hex digits of the MD5 of a name without white space, case and signs; empty where nothing is left."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), SPACE, "")), r"(?U)[^\w가-힣]+", "")
    return F.when(bare == "", "").otherwise(F.substring(F.md5(bare), 1, 16))


def file_stem(path: Column) -> Column:
    """The file name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_hash(path: Column) -> Column:
    """The name hash in a file name: the second part between underscores, else the whole stem; null if neither is 16 hex digits."""
    stem = file_stem(path)
    second, hexes = F.get(F.split(stem, "_"), F.lit(1)), "^[0-9a-fA-F]{16}$"
    return F.when(second.rlike(hexes), F.lower(second)).when(stem.rlike(hexes), F.lower(stem))


def file_name(name: Column, prefix: Column, extension: Column, suffix: Column | None = None) -> Column:
    """``prefix_hash[_suffix].extension``; a name without letters and digits takes the hash of its text."""
    h = name_hash(name)
    h = F.when(h == "", F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, 16)).otherwise(h)
    stem = F.concat_ws("_", prefix, h, *([] if suffix is None else [suffix]))
    return F.concat(stem, F.when(extension.startswith("."), extension).otherwise(F.concat(F.lit("."), extension)))


def without_brackets(name: Column) -> Column:
    """Bracket signs removed, their content kept."""
    return F.trim(F.translate(name, "()[]{}", ""))


def clean_text(text: Column) -> Column:
    """Lower case, signs to blanks, then what stood in round brackets as it was, blank-joined at the end."""
    low = F.lower(F.coalesce(text, F.lit("")))
    inside = F.array_join(F.regexp_extract_all(low, F.lit(r"\(([^)]*)\)"), 1), " ")
    outside = squeeze(F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", " "), r"(?U)[^\w\s가-힣]", " "))
    return F.when(F.regexp_count(low, F.lit(r"\([^)]*\)")) > 0, F.concat(outside, F.lit(" "), inside)).otherwise(outside)


def name_tokens(name: Column) -> Column:
    """Words of the cleaned name; a word that begins with digits and letters becomes these two, and its rest is dropped."""
    return split_words(words(clean_text(name)))


def split_words(words_: Column) -> Column:
    """The tokens of :func:`name_tokens` of a cleaned name's words."""

    def parts(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^(\d+)([a-z가-힣]+)", 1)
        both = F.when(digits != "", F.array(digits, F.regexp_extract(token, r"^(\d+)([a-z가-힣]+)", 2))).otherwise(F.array(token))
        return F.when(F.substring(token, 1, 1).between("0", "9"), both).otherwise(F.array(token))

    return F.flatten(F.transform(words_, parts))


def numbers(text: Column) -> Column:
    """All runs of digits."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), 1)


def token_set(text: Column) -> Column:
    """Distinct lower-case words without signs."""
    return F.array_distinct(words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s]", ""))))


def base_keyword(name: Column) -> Column:
    """What stands before the first round bracket."""
    return F.trim(F.substring_index(name, "(", 1))


#: Shapes of model codes, and a brand's two spellings
MODEL_CODES = (r"[A-Z]{1,5}[-]?\d+[-]?[A-Za-z0-9]*", r"\d+[A-Z]{1,5}", r"[A-Z]{1,5}[-]?\d+[-]?[A-Za-z0-9]*[-][A-Za-z0-9]*")
BRAND = ("777", "쓰리쎄븐")
STOP_WORDS = ("더", "신", "새", "구", "및", "용", "품")


def without_codes(name: Column, patterns: tuple[str, ...] = MODEL_CODES) -> Column:
    out = name
    for p in patterns:
        out = F.regexp_replace(out, rf"(?iU)\b({p})\b", "")
    return squeeze(out)


def keyword_variations(name: Column, most: int | None = 4) -> Column:
    """Search keywords in order: the name, without codes, its ends, the brand's other spelling, without signs, one script only.

    Each stands once, is longer than two characters, and at most ``most`` are returned (None: all). A null name has none.
    """
    whole = F.trim(name)
    bare = without_codes(whole)
    parts = words(bare)
    n = F.size(parts)
    ends = F.when(n >= 5, F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, n - 2), F.get(parts, n - 1))).when(n >= 3, F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, n - 1)))
    spellings = [F.regexp_replace(c, rf"(?U)\b{a}\b", b) for a, b in (BRAND, BRAND[::-1]) for c in (name, bare)]
    plain = squeeze(F.regexp_replace(name, r"[-_+.,#]", " "))
    mixed = name.rlike("[가-힣]") & name.rlike("[a-zA-Z]")

    def script(letters: str) -> Column:
        runs = F.regexp_extract_all(name, F.lit(f"([{letters}]+)"), 1)
        return F.when(mixed & (F.length(F.array_join(runs, "")) > 3), F.array_join(runs, " "))

    listed = F.array(whole, F.when(F.length(bare) > 3, bare), F.when(F.length(ends) > 3, ends), *spellings, plain, script("가-힣"), script("a-zA-Z"))
    kept = F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: F.length(x) > 2))
    return F.coalesce(kept if most is None else F.slice(kept, 1, most), F.array().cast("array<string>"))


def meaningful_keywords(name: Column, most: int = 3) -> Column:
    """The first word, the longest in between, and the last; all words where there are no more than ``most``."""
    name = F.coalesce(name, F.lit(""))
    bare = squeeze(F.regexp_replace(name, r"(?iU)\b([A-Z]{1,}[-]?\d{1,}[-]?[A-Za-z0-9]*)\b", ""))
    parts = words(F.when(bare == "", name).otherwise(bare))
    n = F.size(parts)
    good = lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)
    first = F.filter(F.slice(parts, 1, 1), good)
    between = F.filter(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), good)
    ranked = F.array_sort(F.transform(between, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    middle = F.slice(F.transform(ranked, lambda x: x["w"]), 1, F.greatest(F.lit(most - 1) - F.size(first), F.lit(0)))
    last = F.filter(F.slice(parts, F.greatest(n, F.lit(1)), 1), good)
    return F.when(n <= most, parts).otherwise(F.slice(F.concat(first, middle, last), 1, most))


def digits_or_zero(text: Column) -> Column:
    """The digits of a quantity or price as a number; 0 for ``미만`` (below) and for no digits."""
    return F.when(text.contains("미만"), 0).otherwise(F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("long"), F.lit(0))).cast("long")


def range_start(text: Column) -> Column:
    """The digits before ``~`` or ``-`` of a quantity range; null for none."""
    return F.regexp_replace(F.substring_index(F.substring_index(text, "~", 1), "-", 1), r"\D", "").try_cast("long")


def whole_quantity(text: Column) -> Column:
    """A positive whole number from text with commas, decimals cut; else null."""
    n = F.regexp_replace(text.cast("string"), ",", "").try_cast("double")
    return F.when(F.floor(n) > 0, F.floor(n)).cast("long")


def query_value(url: Column, *keys: str) -> Column:
    """The value of the first of ``keys`` that the query of ``url`` has."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, rf"[?&]{k}=([A-Za-z0-9_-]+)", 1), F.lit("")) for k in keys])


def url_id(url: Column) -> Column:
    """An item's id: of its query, or the path's last part if that is letters and digits."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)
    return F.coalesce(query_value(url, "it_id", "goodsNo"), F.when(last.rlike("^[A-Za-z0-9]+$"), last))


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://"), F.lit(False))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalise_url(url: Column, https_hosts: tuple[str, ...] = ()) -> Column:
    """Backslashes become slashes, ``//`` gets a scheme, and bare or http addresses of ``https_hosts`` get https."""
    u = F.translate(F.trim(url), "\\", "/")
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    for h in https_hosts:
        u = F.when(u.startswith(h), F.concat(F.lit("https://"), u)).when(u.startswith(f"http://{h}"), F.concat(F.lit("https://"), F.substring(u, 8, F.length(u)))).otherwise(u)
    return u


#: Extensions of pages and of images
PAGE_EXTENSIONS = (".asp", ".aspx", ".php", ".jsp", ".html", ".htm")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")


def url_extension(url: Column) -> Column:
    """The extension of a URL's path in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(url_path(url), r"(\.[^./]*)$", 1))


def is_image_url(url: Column) -> Column:
    """Neither a page's extension, nor none, nor one of over five characters."""
    e = url_extension(url)
    return F.coalesce((e != "") & (F.length(e) <= 5) & ~e.isin(*PAGE_EXTENSIONS), F.lit(False))


def cached_file(url: Column) -> Column:
    """The name under which a downloaded image is kept; null for pages."""
    e = url_extension(url)
    return F.when(~e.isin(*PAGE_EXTENSIONS), F.concat(F.md5(url), F.when(e.isin(*IMAGE_EXTENSIONS), e).otherwise(".jpg")))


def normalise_image_url(url: Column, base: str, hosts: tuple[str, ...] = (), area: str = "/ez", uploads: str = "/upload/") -> Column:
    """``struct(url, valid)``: absolute image address; on ``hosts`` uploads move below ``area``.

    Empty and ``data:`` addresses are invalid and empty; relative ones are joined to ``base``.
    """
    def on_hosts(c: Column) -> Column:
        out = F.lit(False)
        for h in hosts:
            out = out | c.contains(h)
        return out

    base_root = F.lit(base.rstrip("/"))
    raw = F.coalesce(url, F.lit(""))
    full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    host, path = url_host(full), url_path(full)
    moved = F.when(on_hosts(host) & ~path.contains(f"{area}/") & path.startswith(uploads), F.concat(F.regexp_extract(full, "^(https?)", 1), F.lit("://"), host, F.lit(area), path)).otherwise(full)
    sound = on_hosts(host) | ((host != "") & (path != ""))
    rel = F.when(raw.startswith("./"), F.substring(raw, 3, F.length(raw))).otherwise(raw)
    rel = F.when(rel.startswith("/"), rel).otherwise(F.concat(F.lit("/"), rel))
    rel = F.when(F.lit(any(h in base for h in hosts)) & rel.startswith(uploads), F.concat(F.lit(area), rel)).otherwise(rel)
    joined = F.replace(F.concat(base_root, rel), F.lit(f"{area}{area}/"), F.lit(f"{area}/"))
    found = lambda u, ok: F.struct(u.alias("url"), ok.alias("valid"))
    return (
        F.when((raw == "") | raw.startswith("data:image/"), found(F.lit(""), F.lit(False)))
        .when(raw.startswith("//") & (host == ""), found(F.lit(""), F.lit(False)))
        .when(is_http(full), found(moved, sound))
        .otherwise(found(joined, F.lit(base.startswith("http"))))
    )


def strip_tags(html: Column) -> Column:
    """Text without its tags."""
    return F.trim(F.regexp_replace(html, "<.*?>", ""))


def natural_key(name: Column) -> Column:
    """A key that sorts runs of digits by value: zeros are put before each run."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def contains_any(c: Column, words_: tuple[str, ...], fold: bool = True) -> Column:
    """Whether a text holds any of the words; null holds none."""
    text = F.lower(c) if fold else c
    out = F.lit(False)
    for w in words_:
        out = out | text.contains(w.lower() if fold else w)
    return F.coalesce(out, F.lit(False))
