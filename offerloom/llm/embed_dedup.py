"""Near-duplicate embeddings: spherical k-means deals unit vectors to cells, blocked cosine products compare within cells.

Equal vectors of one label are one class before anything is compared. Centres are fitted for each label on a bounded sample. A
vector belongs to the cell of its nearest centre and visits each later cell whose border it lies near enough for a link across
to be possible: two unit vectors at an angle of ``t`` or less on different sides of a border are both within ``sin t`` of it. So no link is lost,
whatever the centres. A cell's own vectors are cut into blocks of bounded size; each block meets its own vectors, those of
later blocks, and the visitors, as matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable
from .simhash import merge

#: Room for rounding where a border is tested; far wider than the error of a sum of products.
EPS = 1e-7


def fit_centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``k`` unit centres of the unit rows of ``x`` by spherical k-means; fewer rows give fewer centres."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[at : at + 2048] @ c.T, axis=1) for at in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    # by a power of two, which rounds nothing, so that squares of very small or large components stay within range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(table: DataFrame, threshold: float = 0.93, cell: int = 512, block: int = 1024, sample: int = 20_000, max_cells: int = 1024) -> DataFrame:
    """One row per row of ``table``: ``vec_id, n_links, component_id, kept``.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is ``threshold`` or more
    (between 0 and 1). ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest ``vec_id`` reachable and
    ``kept`` says whether that is the row's own. Vectors that are null, empty, zero or hold a null or a non-finite component link
    with nothing, and so do vectors of different lengths. Rows that repeat each count. An empty table gives none. Other columns aren't read.

    ``sample`` bounds the vectors, over all labels, on which centres are fitted (the driver holds them; a label that is not in it has one cell),
    ``cell`` is the size a cell should have, ``max_cells`` the most centres of one label: with ``sample`` it bounds what is broadcast. ``block``
    bounds what a task holds. A larger cell has more blocks; every pair in it is compared all the same.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    spark = table.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = table.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.col("label").cast("string")).alias("label"), v.alias("v"))
    rows = rows.withColumn("label", F.when(F.col("label").isNotNull(), F.concat_ws(":", F.size("v"), "label")))
    # 0.0 and -0.0 are one value to a grouping, and to a cosine
    classes = rows.filter("label is not null").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label").count()
    total = classes.count()
    part = min(1.0, sample / total) if total else 0.0
    drawn = classes.filter((F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(part * (1 << 30)))).select("label", "v").limit(sample).toPandas()
    counts = {r["label"]: r["count"] for r in sizes.join(F.broadcast(spark.createDataFrame([(x,) for x in set(drawn["label"])], "label string")), "label").collect()} if len(drawn) else {}
    centres = {label: fit_centres(_unit(own["v"]), min(max_cells, max(1, math.ceil(counts[label] / cell)))) for label, own in drawn.groupby("label")}
    shared = spark.sparkContext.broadcast(centres)
    sine = math.sin(math.acos(threshold)) + EPS

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, own in pdf.groupby("label"):
                c = shared.value.get(label)
                if c is None or len(c) == 1:
                    yield pd.DataFrame({"node": own["node"], "label": label, "cell": 0, "home": True})
                    continue
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))  # the centres are unit vectors
                for at in range(0, len(own), 1024):
                    some = own.iloc[at : at + 1024]
                    node, s = some["node"].to_numpy(), _unit(some["v"]) @ c.T
                    home = np.argmax(s, axis=1)
                    gap = s[np.arange(len(s)), home][:, None] - s
                    near = (gap <= sine * apart[home] + EPS) & (np.arange(len(c))[None, :] > home[:, None])
                    i, j = np.nonzero(near)
                    yield pd.DataFrame({"node": np.concatenate((node, node[i])), "label": label, "cell": np.concatenate((home, j)), "home": np.concatenate((np.ones(len(node), bool), np.zeros(len(i), bool)))})

    placed = durable(classes.select("node", "label", "v").mapInPandas(assign, "node long, label string, cell int, home boolean"), "cells")
    blocks = placed.filter("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(blocks, ["label", "cell"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a vector at home stands in its own block and is held against the blocks before; a visitor is held against all
    goes = F.when(F.col("home"), F.sequence(F.lit(0), own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = placed.withColumn("own", own).select("node", "label", "cell", "home", "own", F.explode(goes).alias("tile"))
    tiles = tiles.select("node", "label", "cell", "tile", (F.col("home") & (F.col("own") == F.col("tile"))).alias("held")).join(classes.select("node", "v", "n"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, base, node, n = None, None, None, None
        links: np.ndarray | None = None
        label: np.ndarray | None = None

        def close() -> Iterator[pd.DataFrame]:
            if node is not None and len(node):
                yield pd.DataFrame({"a": node, "b": node[label], "links": links})

        waiting: list[pd.DataFrame] = []

        def open_base() -> None:
            nonlocal base, node, n, links, label
            own = pd.concat(waiting)
            base, node, n = _unit(own["v"]), own["node"].to_numpy(), own["n"].to_numpy()
            near = base @ base.T >= threshold
            np.fill_diagonal(near, False)
            links = near @ n
            label = merge(len(node), *np.nonzero(near))
            waiting.clear()

        for pdf in batches:
            for key, own in pdf.groupby(["label", "cell", "tile"], sort=False):
                if key != at:
                    if waiting:
                        open_base()
                    yield from close()
                    at, base, node = key, None, None
                held = own["held"].to_numpy()
                if held.any():
                    waiting.append(own[held])
                guests = own[~held]
                if not len(guests):
                    continue
                if waiting:
                    open_base()
                if base is None:
                    continue
                for i in range(0, len(guests), 1024):
                    some = guests.iloc[i : i + 1024]
                    near = _unit(some["v"]) @ base.T >= threshold
                    g, h = np.nonzero(near)
                    if not len(g):
                        continue
                    links += some["n"].to_numpy() @ near
                    first = near.argmax(axis=1)
                    label = merge(len(node), first[g], h, label)
                    any_ = near.any(axis=1)
                    yield pd.DataFrame({"a": some["node"].to_numpy()[any_], "b": node[first[any_]], "links": (near @ n)[any_]})
        if waiting:
            open_base()
        yield from close()

    found = tiles.repartition("label", "cell", "tile").sortWithinPartitions("label", "cell", "tile", F.desc("held")).select("label", "cell", "tile", "held", "node", "n", "v")
    found = durable(found.mapInPandas(compare, "a long, b long, links long"), "links")
    of = components(found.select("a", "b"))
    direct = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("node", "label", "v", "n", "low").join(direct, "node", "left").join(of, "node", "left")
    named = durable(named.select("label", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(low, "component").select(F.col("label").alias("__l"), F.col("v").alias("__v"), "n_links", "component_id")
    named = durable(named, "named_classes")
    out = rows.join(named, (rows["label"] == named["__l"]) & (rows["v"] == named["__v"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
