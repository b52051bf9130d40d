"""Streams over event tables: exact deduplication, windowed profiles, drift per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import detect_numeric_drift


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with time zone semantics."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's delay; state older than that is dropped."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_profile(df: DataFrame, ts: str, value: str, group: str, width: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, group, n, n_missing, mean, min, max) of tumbling or sliding windows; late rows within the delay count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = event_time(df, ts).withWatermark(ts, delay).groupBy(w.alias("w"), F.col(group))
    out = g.agg(F.count("*").alias("n"), F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).alias("n_missing"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), group, "n", "n_missing", "mean", "min", "max")


def session_counts(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, end, key, n): sessions that end after ``gap`` without an event."""
    g = event_time(df, ts).withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), F.col(key))
    return g.agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def drift_per_batch(df: DataFrame, reference: DataFrame, columns: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Numeric drift of every micro-batch against a static reference, handed to ``sink``."""

    def one(batch: DataFrame, number: int) -> None:
        sink(detect_numeric_drift(reference, batch, columns).withColumn("batch", F.lit(number)), number)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
