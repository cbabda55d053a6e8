"""Event-time aggregates over streams: tumbling, sliding and session windows with watermarks.

Each works on a streaming or a batch DataFrame.  Timestamps without a zone are taken as UTC instants, as watermarks need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late else df


def _flat(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *names)


def tumbling(df: DataFrame, ts: str, size: str, aggregates: dict[str, Column], keys: list[str] = (), late: str | None = None) -> DataFrame:
    return sliding(df, ts, size, size, aggregates, keys, late)


def sliding(df: DataFrame, ts: str, size: str, step: str, aggregates: dict[str, Column], keys: list[str] = (), late: str | None = None) -> DataFrame:
    out = _timed(df, ts, late).groupBy(F.window(ts, size, step).alias("window"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return _flat(out, [*keys, *aggregates])


def session(df: DataFrame, ts: str, gap: str, aggregates: dict[str, Column], keys: list[str] = (), late: str | None = None) -> DataFrame:
    out = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return _flat(out, [*keys, *aggregates])


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    df = _timed(df, ts, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def read(spark, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, period: str | None = "60 seconds"):
    """Moves a stream to a table: `write` gets each micro-batch; without a period what is there is moved, and the query ends."""
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=period) if period else w.trigger(availableNow=True)).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for `drain` that a repeated batch does not double: each batch has its own folder, which is replaced."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
