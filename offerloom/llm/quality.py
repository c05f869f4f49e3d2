"""Quality by co-training: one classifier reads the text, another its metadata, and each teaches the other.

Both views are logistic regressions fitted on a bounded sample of labelled rows. In each round both views score all other documents, and each
labels the rows it is surest of, which go into the other view's training rows. At the end each view is calibrated on labelled rows held out
from all of that, and a last regression on both calibrated scores gives the probability that scores every document.

Where the labels say which documents are toxic, a second model of the same form learns that. Its text view counts a document's words
that the sample's toxic documents hold far more often than the others; those words are learnt, too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

TEXT_EXTRA = 7
HARM = 3
#: Lower case, and a blank for each ASCII byte that is no letter
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LENGTHS = 24


def text_view(data: bytes | None) -> np.ndarray:
    """Features of a whole text: how often each byte occurs (square roots of shares), and shares of shape, words and lines."""
    data = data or b""
    n = len(data)
    out = np.zeros(256 + TEXT_EXTRA)
    if not n:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n)
    words, lines = data.split(), data.split(b"\n")
    share = out[:256] ** 2
    out[256:] = (
        math.log1p(n),
        share[65:91].sum(),
        share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum(),
        len(set(words)) / max(1, len(words)),
        min(n / max(1, len(words)), 50.0) / 10,
        len(set(lines)) / len(lines),
        max(map(len, words), default=0) / (len(words) + 50.0),
    )
    return out


def plain_words(data: bytes | None) -> set[bytes]:
    """The distinct words of a whole text, A-Z lower-cased."""
    return set((data or b"").translate(PLAIN).split())


def harm_view(data: bytes | None, harmful: dict[bytes, float]) -> np.ndarray:
    """Features of a whole text: how many distinct words are in ``harmful``, the root of their weights' sum, and their share of the distinct words."""
    own = plain_words(data)
    hits = [harmful[w] for w in own & harmful.keys()]
    return np.array((math.log1p(len(hits)), math.sqrt(max(sum(hits), 0.0)), len(hits) / max(1, len(own))))


class Meta:
    """Places of metadata values: a source and a language that the sample has, others, and null each have one; lengths go by their logarithm."""

    def __init__(self, sources: set[str], langs: set[str]):
        self.sources = {x: 2 + i for i, x in enumerate(sorted(sources))}
        self.langs = {x: 2 + i for i, x in enumerate(sorted(langs))}
        self.size = 4 + len(sources) + len(langs) + LENGTHS

    def places(self, source: str | None, lang: str | None, n_chars: float | None) -> tuple[int, int, int]:
        bad = n_chars is None or n_chars != n_chars or n_chars < 0
        s = 0 if source is None else self.sources.get(source, 1)
        g = 0 if lang is None else self.langs.get(lang, 1)
        return s, 2 + len(self.sources) + g, 4 + len(self.sources) + len(self.langs) + (0 if bad else min(LENGTHS - 1, 1 + int(math.log1p(n_chars) * 1.5)))

    def view(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), self.size))
        out[np.arange(len(places))[:, None], places] = 1
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, scale, coefficients)`` of a ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w = np.ones(len(x)) if weight is None else weight
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (w * (p - y)) + penalty * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


def logit(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, b = model
    return np.clip(((x - mean) / scale) @ b[:-1] + b[-1], -30, 30)


class CoTrainer:
    """Two views that teach each other, from rows labelled 0 or 1 in ``y`` (others are passed over).

    The rows marked in ``held`` are kept for calibration. The cut is where at most one in 500 of the held rows labelled 1 fall below it, and ``highest`` at most.
    """

    def __init__(self, views: list[np.ndarray], y: np.ndarray, held: np.ndarray, sure: float, highest: float):
        base, self.held = np.flatnonzero((y >= 0) & ~held), np.flatnonzero((y >= 0) & held)
        self.views, self.y, self.sure, self.highest = views, y, sure, highest
        self.ready = min(len(set(y[base])), len(set(y[self.held]))) == 2
        self.rows = [(v[base], y[base].astype(float)) for v in views]
        self.models: list = []

    def fit(self) -> None:
        self.models = [fit_logistic(x, y) for x, y in self.rows]

    def learn(self, view: int, x: np.ndarray, label: int) -> None:
        """Rows for ``view`` that the other one has labelled."""
        own = self.rows[view]
        self.rows[view] = (np.concatenate((own[0], x)), np.concatenate((own[1], np.full(len(x), float(label)))))

    def finish(self) -> dict:
        held, y = self.held, self.y[self.held]
        scores = [logit(m, x[held])[:, None] for m, x in zip(self.models, self.views)]
        scaled = [fit_logistic(x, y) for x in scores]
        both = np.stack([logit(s, x) for s, x in zip(scaled, scores)], axis=1)
        last = fit_logistic(both, y)
        good = 1 / (1 + np.exp(-logit(last, both[y == 1])))
        return {"views": self.models, "scales": scaled, "last": last, "cut": float(min(self.highest, np.quantile(good, 0.002)))}


def predict(model: dict | None, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(text), 0.5)
    both = np.stack([logit(s, logit(m, x)[:, None]) for s, m, x in zip(model["scales"], model["views"], (text, meta))], axis=1)
    return 1 / (1 + np.exp(-logit(model["last"], both)))


def _views(texts: pd.Series, sources: pd.Series, langs: pd.Series, sizes: pd.Series, harmful: dict[bytes, float], meta: Meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the texts, of their words, and the places of their metadata."""
    none = lambda x: None if x is None or x != x else x
    if not len(texts):
        return np.zeros((0, 256 + TEXT_EXTRA)), np.zeros((0, HARM)), np.zeros((0, 3), np.int32)
    places = np.array([meta.places(none(s), none(g), none(n)) for s, g, n in zip(sources, langs, sizes)], np.int32)
    return np.stack([text_view(t) for t in texts]), np.stack([harm_view(t, harmful) for t in texts]), places


def _columns(docs: DataFrame) -> list[Column]:
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    return [F.col("text").cast("binary"), have("source", "string"), have("lang", "string"), have("n_chars", "double")]


def _harmful(sample: DataFrame, least: float = 20.0) -> dict[bytes, float]:
    """Words with their log odds: those whose odds between toxic and other labelled rows stand out by ``least`` or more. The sample bounds them."""
    known = sample.filter("harmless >= 0 and not held")
    sizes = known.agg(F.coalesce(F.sum("harmless"), F.lit(0)).alias("no"), F.count("*").alias("all")).first()
    no, yes = sizes["no"], sizes["all"] - sizes["no"]

    def split(batches):
        for pdf in batches:
            sets = [plain_words(t) for t in pdf["t"]]
            yield pd.DataFrame({"word": [w for own in sets for w in own], "harmless": np.repeat(pdf["harmless"].to_numpy(), [len(own) for own in sets])})

    count = known.select("t", "harmless").mapInPandas(split, "word binary, harmless long").groupBy("word").agg(F.sum("harmless").alias("c"), F.sum(1 - F.col("harmless")).alias("a"))
    odds = F.log((F.col("a") + 0.5) / (yes + 1.0) / ((F.col("c") + 0.5) / (no + 1.0)))
    best = count.withColumn("odds", odds).withColumn("g", 2 * F.col("a") * F.col("odds")).filter(F.col("g") >= least)
    return {bytes(r.word): r.odds for r in best.collect()}


def _pool(docs: DataFrame, taken: DataFrame, harmful: dict[bytes, float], meta: Meta) -> DataFrame:
    """``(doc_id, th, x, h, p)``: the features of every document but those of ``taken(doc_id)``, as bytes; ``taken`` is the bounded sample."""
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), *[c.alias(n) for c, n in zip(_columns(docs), "tsgn")])
    own = own.filter("doc_id IS NOT NULL").join(F.broadcast(taken), "doc_id", "left_anti")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                text, harm, places = _views(some["t"], some["s"], some["g"], some["n"], harmful, meta)
                cells = [[x.tobytes() for x in part] for part in (text.astype(np.float32), harm.astype(np.float32), places)]
                yield pd.DataFrame({"doc_id": some["doc_id"], "th": some["th"], "x": cells[0], "h": cells[1], "p": cells[2]})

    return own.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, x binary, h binary, p binary")


def _unpacked(pdf: pd.DataFrame, meta: Meta) -> dict[str, np.ndarray]:
    cells = lambda c, kind, n: np.frombuffer(b"".join(pdf[c]), kind).reshape(len(pdf), n)
    return {"text": cells("x", np.float32, 256 + TEXT_EXTRA).astype(float), "harm": cells("h", np.float32, HARM).astype(float), "meta": meta.view(cells("p", np.int32, 3))}


#: What each kind of label is learnt from
VIEWS = {"good": ("text", "meta"), "harmless": ("harm", "meta")}


def _surest(pool: DataFrame, trainers: dict[str, CoTrainer], meta: Meta, grow: int, told: set) -> pd.DataFrame:
    """Of all rows of ``pool``, the ``grow`` that each view of each trainer is surest of, either way: ``slot`` names kind, teacher and label."""
    models = {k: (t.models, t.sure) for k, t in trainers.items()}
    shared = pool.sparkSession.sparkContext.broadcast((models, meta, told))

    def run(batches):
        models, meta, told = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            views = _unpacked(pdf, meta)
            out = []
            for kind, (own, sure) in models.items():
                for v in (0, 1):
                    p = np.round(1 / (1 + np.exp(-logit(own[v], views[VIEWS[kind][v]]))), 9)
                    for label, far in ((0, p), (1, 1 - p)):
                        slot = f"{kind}:{v}:{label}"
                        near = np.flatnonzero(far <= 1 - sure)
                        some = pdf.iloc[near].assign(slot=slot, far=far[near])
                        new = [(slot[:-2], i, t) not in told for i, t in zip(some["doc_id"], some["th"])]
                        some = some[np.array(new, bool)]
                        out.append(some.sort_values(["far", "doc_id", "th"]).head(grow))
            yield pd.concat(out)[["slot", "far", "doc_id", "th", "x", "h", "p"]]

    found = pool.mapInPandas(run, f"slot string, far double, doc_id {pool.schema['doc_id'].dataType.simpleString()}, th long, x binary, h binary, p binary")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("far", "doc_id", "th"))  # cut to grow rows before the shuffle, too
    return found.withColumn("r", rank).filter(F.col("r") <= grow).drop("r").toPandas()


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 4000, rounds: int = 3, grow: int = 100) -> dict | None:
    """Co-trained models from at most ``labelled`` rows of ``labels(doc_id, quality, toxic)`` and all other documents.

    The labelled sample is the rows with the least hash of their ``doc_id``; every fourth is held out. In each of ``rounds`` rounds all documents outside it are
    scored, and a view labels for the other the ``grow`` rows of each kind it is surest of. Null ids and labels are left out; a
    document labelled twice takes the worse label. ``toxic`` may be missing. ``good`` or ``harmless`` is None if one of its labels is missing
    among the sample: then there is nothing to learn.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit("sample"))
    toxic = F.col("toxic").cast("int") if "toxic" in labels.columns else F.lit(None).cast("int")
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.min(1 - toxic).alias("harmless"))
    marked = marked.filter("quality is not null or harmless is not null").fillna(-1, ["quality", "harmless"])
    ids = marked.orderBy(order, "doc_id").limit(labelled).toPandas().sort_values("doc_id")
    ids["held"] = np.arange(len(ids)) % 4 == 3
    if not len(ids):
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = spark.createDataFrame(ids.astype({"quality": int, "harmless": int, "held": bool}), f"doc_id {kind}, quality long, harmless long, held boolean")
    # at most labelled ids: a bounded table
    own = Table(docs.select("doc_id", F.xxhash64("text").alias("th"), *[c.alias(n) for c, n in zip(_columns(docs), "tsgn")]).join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id", "th"]), "sample")
    harmful = _harmful(own.df)
    seen = own.df.agg(F.collect_set("s").alias("s"), F.collect_set("g").alias("g")).first()
    meta = Meta(set(seen.s), set(seen.g))

    def features(batches):
        for pdf in batches:
            text, harm, places = _views(pdf["t"], pdf["s"], pdf["g"], pdf["n"], harmful, meta)
            cells = [[x.tobytes() for x in part] for part in (text.astype(np.float32), harm.astype(np.float32), places)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "quality": pdf["quality"], "harmless": pdf["harmless"], "held": pdf["held"], "x": cells[0], "h": cells[1], "p": cells[2]})

    rows = own.df.mapInPandas(features, f"doc_id {kind}, th long, quality long, harmless long, held boolean, x binary, h binary, p binary").toPandas()
    rows = rows.sort_values(["doc_id", "th"]).drop_duplicates("doc_id")
    own.drop()
    if not len(rows):
        return None
    views, held = _unpacked(rows, meta), rows["held"].to_numpy(bool)
    trainers = {"good": CoTrainer([views[v] for v in VIEWS["good"]], rows["quality"].to_numpy(int), held, 0.95, 0.5)}
    if harmful:  # without words to go by, metadata alone must not call a document toxic
        trainers["harmless"] = CoTrainer([views[v] for v in VIEWS["harmless"]], rows["harmless"].to_numpy(int), held, 0.98, 0.75)
    trainers = {k: t for k, t in trainers.items() if t.ready}
    if trainers:
        pool, told = Table(_pool(docs, few.select("doc_id"), harmful, meta), "features"), set()
        for r in range(rounds + 1):
            for t in trainers.values():
                t.fit()
            if r == rounds:
                break
            new = _surest(pool.df, trainers, meta, grow, told)
            for slot, part in new.groupby("slot"):
                name, teacher, label = slot.split(":")
                other = 1 - int(teacher)
                trainers[name].learn(other, _unpacked(part, meta)[VIEWS[name][other]], int(label))
                told |= {(slot[:-2], i, t) for i, t in zip(part["doc_id"], part["th"])}
            if not len(new):
                break
        pool.drop()
    return {"good": None, "harmless": None, "harmful": harmful, "meta": meta} | {k: t.finish() for k, t in trainers.items()}


def _scorer(docs: DataFrame, model: dict | None) -> Column:
    """``good double, harmless double, keep boolean`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or {"good": None, "harmless": None, "harmful": {}, "meta": Meta(set(), set())})

    @F.pandas_udf("good double, harmless double, keep boolean")
    def score(t: pd.Series, s: pd.Series, g: pd.Series, n: pd.Series) -> pd.DataFrame:
        model, out = shared.value, [np.zeros((0, 3))]
        cuts = [model[c]["cut"] if model[c] else 0.5 for c in ("good", "harmless")]
        for at in range(0, len(t), 1024):
            cut = slice(at, at + 1024)
            text, harm, places = _views(t.iloc[cut], s.iloc[cut], g.iloc[cut], n.iloc[cut], model["harmful"], model["meta"])
            meta = model["meta"].view(places)
            good = predict(model["good"], text, meta)
            harmless = predict(model["harmless"], harm, meta) if model["harmless"] else np.ones(len(text))
            out.append(np.stack([np.round(good, 6), np.round(harmless, 6), (good >= cuts[0]) & (harmless >= cuts[1])], axis=1))
        found = np.concatenate(out)
        return pd.DataFrame({"good": found[:, 0], "harmless": found[:, 1], "keep": found[:, 2] > 0})

    return score(*_columns(docs))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = 4000) -> DataFrame:
    """``doc_id, score, harmless, keep`` for each row of ``docs``: the probability that it is good, and that it isn't toxic.

    ``keep`` is false where either is below its cut, which at most one in 500 of the good (or harmless) rows held out fell under and never exceeds
    0.5 (0.75). Without labels of both kinds ``score`` is 0.5 (``harmless`` 1) and every row kept. A null text counts as an empty one; null or missing
    metadata are values of their own. An empty table gives none.
    """
    found = docs.select("doc_id", _scorer(docs, fit(docs, labels, labelled)).alias("found"))
    return found.select("doc_id", F.col("found.good").alias("score"), "found.harmless", "found.keep")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`classify` doesn't keep; columns stay. Nulls, empty tables and missing labels are as there; rows that repeat share their lot."""
    return docs.filter(_scorer(docs, fit(docs, labels))["keep"]).select(*docs.columns)
