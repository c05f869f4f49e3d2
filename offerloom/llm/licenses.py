"""Licence scans by a positional index of rare words, with DataFrame operations only.

Template notices are indexed by their less common words. Each licence word of a document is looked up, and each posting says where the
template would start if this word is part of it. Starts on which enough
words of one template agree are candidates, and one is a find only if all the key phrases of its licence stand there too.
Nothing is dealt over the cluster but the licence words of documents that have some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .urls import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label) that any text is searched for
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, notice, key phrases)
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("public domain", "cc0")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("modify and or distribute",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
)
#: Words of the notices that aren't looked up
COMMON = ("0", "1", "2", "3", "4", "a", "and", "any", "are", "by", "for", "in", "is", "of", "or", "the", "this", "to", "under", "use", "with")
SLACK = 3


def _vocabulary() -> list[str]:
    words = {w for _, notice, keys in TEMPLATES for w in " ".join((notice, *keys)).split()} | {w for phrase, _ in BASE for w in phrase.split()}
    return sorted(words - set(COMMON) - {"all"})


def _phrases() -> list[tuple[tuple[str, ...], int]]:
    """The words of each phrase, and which of them leads to it; the phrases of ``BASE`` come first."""
    listed = dict.fromkeys([p for p, _ in BASE] + [p for _, _, keys in TEMPLATES for p in keys])
    vocabulary = set(_vocabulary())
    return [(words := tuple(p.split()), next(i for i, w in enumerate(words) if w in vocabulary)) for p in listed]


def scan(docs: DataFrame, agree: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all phrases of ``BASE``; ``first_word`` and ``last_word`` are the least and greatest start
    in words (null without one). ``labels`` adds the licences whose notice is found to the labels of the phrases. ``score`` is the
    share of a found notice's indexed words that agree on its start, the best one's; 0.5 at least with a phrase, else 0. All
    licence words of a document vote, however many notices it holds. A null text counts as an empty one. An empty table gives none.
    """
    vocabulary, phrases = _vocabulary(), _phrases()
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)

    def look(ws: Column) -> Column:
        n = F.size(ws)
        at = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, i).isin(vocabulary))).otherwise(F.array().cast("array<int>"))

        def places(at: Column) -> Column:
            def all_of(k: int, words: tuple[str, ...], lead: int) -> Column:
                def stands(i: Column) -> Column:
                    fits = F.get(ws, i) == words[lead]
                    for j, w in enumerate(words):
                        if j != lead:
                            fits = fits & F.coalesce(F.get(ws, i + (j - lead)) == w, F.lit(False))
                    return fits

                return F.transform(F.filter(at, stands), lambda i: F.struct(F.lit(k).alias("phrase"), (i - lead).alias("start")))

            return F.struct(n.alias("n_words"), F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(ws, i).alias("word"))).alias("hits"), F.concat(*[all_of(k, *p) for k, p in enumerate(phrases)]).alias("places"))

        return F.get(F.transform(F.array(at), places), F.lit(0))

    found = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), 0)), look), F.lit(0))
    rows = docs.select("doc_id", found.alias("f")).select(F.monotonically_increasing_id().alias("__row"), "doc_id", "f.*")
    rows = durable(rows, "licence_words")

    postings: dict[str, list[tuple[int, int, int]]] = {w: [] for w in vocabulary}
    indexed = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        own = [(q, w) for q, w in enumerate(notice.split()) if w in postings]
        indexed.append(len(own))
        for i, (q, w) in enumerate(own):
            postings[w].append((t, q, i))
    none = F.array().cast("array<struct<t:int,at:int,word:bigint,key:bigint>>")

    def entry(t: int, at: Column, word: int, key: int) -> Column:
        return F.struct(F.lit(t).alias("t"), at.cast("int").alias("at"), F.lit(word).cast("bigint").alias("word"), F.lit(key).cast("bigint").alias("key"))

    def voted(h: Column) -> Column:
        out = none
        for w, own in postings.items():
            if own:
                out = F.when(h["word"] == w, F.array(*[entry(t, h["pos"] - q, 1 << i, 0) for t, q, i in own])).otherwise(out)
        return out

    names = [" ".join(words) for words, _ in phrases]

    def keyed(p: Column) -> Column:
        out = none
        for k, name in enumerate(names):
            own = [(t, notice.split(), j) for t, (_, notice, keys) in enumerate(TEMPLATES) for j, key in enumerate(keys) if key == name]
            if own:
                spots = [(t, _offset(notice, name.split()) + d, j) for t, notice, j in own for d in range(-SLACK, SLACK + 1)]
                out = F.when(p["phrase"] == k, F.array(*[entry(t, p["start"] - q, 0, 1 << j) for t, q, j in spots])).otherwise(out)
        return out

    some = rows.filter(F.size("hits") > 0)
    votes = some.select("__row", F.explode(F.concat(F.flatten(F.transform("hits", voted)), F.flatten(F.transform("places", keyed)))).alias("v")).select("__row", "v.*")
    votes = votes.groupBy("__row", "t", "at").agg(F.bit_or("word").alias("word"), F.bit_or("key").alias("key"))
    share = F.bit_count("word").cast("double") / F.element_at(F.array(*[F.lit(float(n)) for n in indexed]), F.col("t") + 1)
    needed = F.element_at(F.array(*[F.lit((1 << len(keys)) - 1) for *_, keys in TEMPLATES]), F.col("t") + 1)
    finds = votes.filter((share >= agree) & (F.col("key") == needed)).withColumn("share", share)
    label = F.element_at(F.array(*[F.lit(name) for name, *_ in TEMPLATES]), F.col("t") + 1)
    finds = finds.groupBy("__row").agg(F.collect_set(label).alias("more"), F.max("share").alias("best"))

    base = F.filter("places", lambda p: p["phrase"] < len(BASE))
    starts = F.transform("base", lambda p: p["start"].cast("long"))
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda p: F.element_at(F.array(*[F.lit(name) for _, name in BASE]), p["phrase"] + 1))))
    own = rows.select("__row", "doc_id", F.col("n_words").cast("long").alias("n_words"), base.alias("base"))
    own = own.select("__row", "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels.alias("own"))
    out = own.join(finds, "__row", "left")
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def _offset(notice: list[str], phrase: list[str]) -> int:
    """Where ``phrase`` stands in ``notice``."""
    return next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)


def scan_sql(agree: float = 0.5) -> str:
    """The same in DuckDB SQL."""
    vocabulary, phrases = _vocabulary(), _phrases()
    names = [" ".join(words) for words, _ in phrases]
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    posts = ", ".join(f"({t}, {q}, '{w}')" for t, (_, notice, _) in enumerate(TEMPLATES) for q, w in enumerate(notice.split()) if w in vocabulary)
    keys = ", ".join(f"({t}, {names.index(k)}, {_offset(notice.split(), k.split())})" for t, (_, notice, ks) in enumerate(TEMPLATES) for k in ks)
    sizes = ", ".join(f"({t}, '{name}', {sum(w in vocabulary for w in notice.split())}, {len(ks)})" for t, (name, notice, ks) in enumerate(TEMPLATES))
    listed = ", ".join(f"({k}, [{quoted(words)}])" for k, (words, _) in enumerate(phrases))
    base = ", ".join(f"({k}, '{name}')" for k, (_, name) in enumerate(BASE))
    return rf"""
WITH posts(t, q, word) AS (VALUES {posts}), keys(t, phrase, q) AS (VALUES {keys}), sizes(t, label, n, k) AS (VALUES {sizes}),
phrases(phrase, words) AS (VALUES {listed}), base(phrase, label) AS (VALUES {base}),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
hits AS (SELECT * FROM words WHERE word IN ({quoted(vocabulary)})),
places AS (
  SELECT DISTINCT w.row, p.phrase, w.pos AS start
  FROM words w JOIN phrases p ON w.word = p.words[1] JOIN docs d ON d.row = w.row
  WHERE d.ws[w.pos + 1 : w.pos + len(p.words)] = p.words),
votes AS (
  SELECT row, t, pos - q AS spot, count(DISTINCT q) AS n FROM hits JOIN posts USING (word) GROUP BY ALL),
keyed AS (
  SELECT row, t, start - q - d AS spot, count(DISTINCT phrase) AS k
  FROM places JOIN keys USING (phrase), (SELECT unnest(range(-{SLACK}, {SLACK + 1})) AS d) GROUP BY ALL),
finds AS (
  SELECT row, list(DISTINCT label) AS more, max(v.n::DOUBLE / s.n) AS best
  FROM votes v JOIN sizes s USING (t) JOIN keyed k USING (row, t, spot)
  WHERE v.n::DOUBLE / s.n >= {agree} AND k.k = s.k GROUP BY row),
based AS (
  SELECT row, count(*) AS n, min(start) AS low, max(start) AS high, list(DISTINCT label) AS own FROM places JOIN base USING (phrase) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.low::BIGINT AS first_word, b.high::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       greatest(coalesce(best, 0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM docs LEFT JOIN based b USING (row) LEFT JOIN finds USING (row)"""
