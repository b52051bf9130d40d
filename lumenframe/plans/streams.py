"""Queries that run streaming operators over the event table as a finished stream."""

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming import events as S
from .base import query, table
from .stats import rounded


def drained(spark, stream, mode="append"):
    """Run a stream over all that is there and return what it wrote."""
    name = "stream_" + uuid.uuid4().hex[:12]
    out = f"{shared_folder(spark)}/{name}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def source(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("stream_dedup_users", "SELECT count(DISTINCT user_id || '-' || event_type) AS n_keys, count(DISTINCT user_id) AS n_users FROM events")
def stream_dedup_users(spark, d):
    out = drained(spark, S.dedup_stream(source(spark, d), ["user_id", "event_type"], "ts", "60 days"))
    return out.agg(F.count("*").alias("n_keys"), F.count_distinct("user_id").alias("n_users"))


@query("stream_windowed_profile", "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL) SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, n, round(mean, 6) AS mean FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_windowed_profile(spark, d):
    out = drained(spark, S.windowed_profile(source(spark, d), "ts", "value", "event_type"))
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "mean"))
