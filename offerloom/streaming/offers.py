"""Offers and events as streams: landing files, duplicates by watermark, and windowed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landing(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream. The schema is given, so no file is read to infer it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def new_offers(stream: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """Offers not seen before within the watermark; state older than it is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str = "ts", width: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ("event_type",), value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Counts and sums for each window and key; a batch frame gives the same rows as the stream once all is in."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    got = rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now appended to a Parquet table, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
