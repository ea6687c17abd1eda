"""Streams over files: windows, sessions, late data and sinks (rows S1-S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    for k, v in (("maxFilesPerTrigger", files_per_trigger), ("pathGlobFilter", glob)):
        r = r.option(k, v) if v is not None else r
    return r.load(path)


def tumbling(df: DataFrame, time: str, size: str, by=(), aggs=(), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by window of time (sliding with `slide`); with `late`, rows later than that drop."""
    d = df.withWatermark(time, late) if late else df
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = d.groupBy(w.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, by, aggs, late: str | None = None) -> DataFrame:
    d = df.withWatermark(time, late) if late else df
    out = d.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def dedup(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the Parquet sink and checkpoint make it exactly once."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(df: DataFrame, fn, checkpoint: str, mode: str = "update") -> None:
    """fn(batch DataFrame, batch number) for each micro-batch, until nothing is left."""
    q = df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
