"""Structured Streaming forms of the resumable enrichment and of the daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import attach_label, one_place


def enrich_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    address: str,
    gazetteer: DataFrame,
    target: str,
    checkpoint: str,
    labels: DataFrame | None = None,
    key: str | None = None,
) -> StreamingQuery:
    """Resolve the addresses of files that arrive in ``source`` and append to ``target``.

    The checkpoint remembers the files already processed, so a restarted run
    continues there.  Stops when all present files are done.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    places = one_place(gazetteer).select(
        F.col("address").alias(address), F.col("lat").alias(f"{address}_lat"), F.col("lon").alias(f"{address}_lon")
    )
    resolved = rows.join(places, address, "left")
    if labels is not None:
        resolved = attach_label(resolved, labels, key)
    return (
        resolved.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )


def daily_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    time_col: str,
    target: str,
    checkpoint: str,
    lateness: str = "1 day",
) -> StreamingQuery:
    """Counts per day of arriving rows; a day is written once the watermark has passed it."""
    rows = spark.readStream.schema(schema).parquet(source)
    counts = (
        rows.select(F.col(time_col).cast("timestamp").alias("at"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day"))
        .agg(F.count("*").alias("n"))
        .select(F.to_date("window.start").alias("day"), "n")
    )
    return (
        counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )
