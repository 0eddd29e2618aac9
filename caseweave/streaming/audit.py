"""Audit events: append log, windowed counts, newest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Counts per tumbling window and key; rows later than ``lateness`` are left out of closed windows."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs everything available now into Parquet files and stops."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def newest(events: DataFrame, ts: str, key: str, limit: int | None = None) -> DataFrame:
    """Newest first, the larger key first on ties."""
    ordered = events.orderBy(F.col(ts).desc(), F.col(key).desc())
    return ordered.limit(limit) if limit else ordered
