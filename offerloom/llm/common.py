"""What the operators of this subpackage share: durable intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where intermediate tables go when a local session (a test) names no shared folder.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without the setting; it gets a temporary folder. A cluster without it is refused, since a
    folder of one machine would be lost with that machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="offerloom-"))
    return _OWN[0]


class Table:
    """A DataFrame written as Parquet in the shared folder and read back: its lineage is a list of files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/offerloom-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: later reads need none of the executors that made it."""
    return Table(df, name).df


class Scratch:
    """Written tables that are dropped together once nothing reads them any more."""

    def __init__(self):
        self.tables: list[Table] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Table(df, name))
        return self.tables[-1].df

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables.clear()


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` and text hash (``xxhash64``) are in ``gone(doc_id, th)``; columns stay.

    Of the rows whose key is in ``repeated(doc_id, th)`` one stays, the least by its other columns; only those rows are shuffled for it. Rows
    without a ``doc_id`` stay.
    """
    key = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    rows = docs.withColumn("__h", F.xxhash64("text"))
    match = lambda k: (rows["doc_id"] == k["__id"]) & (rows["__h"] == k["__th"])
    g = key(gone)
    left = rows.join(g, match(g), "left_anti")
    if repeated is None or (r := durable(repeated, "repeated")).isEmpty():
        return left.select(*docs.columns)
    r = key(r)
    plain = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    own = rows.join(g, match(g), "left_anti")
    once = own.join(r, (own["doc_id"] == r["__id"]) & (own["__h"] == r["__th"]), "left_semi")
    w = Window.partitionBy("doc_id", "__h").orderBy(*[F.col(f"`{c}`") for c in plain], F.lit(0))
    once = once.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*docs.columns)
    rest = left.join(r, (left["doc_id"] == r["__id"]) & (left["__h"] == r["__th"]), "left_anti").select(*docs.columns)
    return rest.unionByName(once)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, component)`` for each node that has an edge.

    ``component`` is the smallest node reachable. Large-star and small-star steps alternate until the edges rest; each is a
    minimum by key and a join, so that a node with very many links costs no task more than a split of its rows. Null ends and
    loops are dropped. No edge reaches the driver; only a count and a checksum do. An empty input gives an empty result.
    """
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    table = Table(live.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _sum(table.df)
    while seen[0]:
        both = table.df.union(table.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = Table(large.filter("u <> v").distinct(), "large")
        low = mid.df.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.df.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = Table(small.filter("u <> v").distinct(), "small")
        now = _sum(new.df)
        table.drop()
        mid.drop()
        table = new
        if now == seen:
            break
        seen = now
    nodes = table.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(table.df.select("v", "v").distinct().toDF("node", "component"))


def _sum(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
