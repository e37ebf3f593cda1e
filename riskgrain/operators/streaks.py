"""Current and longest run of a value in an ordered sequence per entity.

A run is a mergeable summary, so sequences are cut into time chunks that are
summarised on their own and merged in order.  Chunks come from quantiles of the
whole table's order column: however many rows one entity has, no task sees more
of them than one chunk holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.order_stats import with_slot

CHUNK_ROWS = 2_000_000


def _with_chunk(df: DataFrame, chunk_rows: int) -> DataFrame:
    """Add the chunk of column ``at``: constant for small tables, else by its quantiles."""
    n = df.count()
    k = -(-n // chunk_rows)
    if k <= 1:
        return df.withColumn("chunk", F.lit(0))
    kind = df.schema["at"].dataType.typeName()
    axis = F.unix_micros(F.col("at").cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col("at")
    cuts = df.agg(F.percentile_approx(axis, [i / k for i in range(1, k)], max(10_000, 20 * k))).first()[0] or []
    return with_slot(df.withColumn("_axis", axis), "_axis", sorted(set(cuts)), out="chunk").drop("_axis")


def streaks(
    df: DataFrame, entity: str, order: str, matches: Column, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per entity the trailing run (``current``) and the longest run (``longest``) of ``matches``.

    ``order`` must be unique within an entity.  A null match breaks a run.
    """
    rows = df.select(
        F.col(entity).alias("entity"), F.col(order).alias("at"),
        F.coalesce(matches, F.lit(False)).alias("hit"),
    )
    rows = _with_chunk(rows, chunk_rows)
    inside = W.partitionBy("entity", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    islands = rows.withColumn("island", F.sum((~F.col("hit")).cast("int")).over(inside))
    runs = islands.groupBy("entity", "chunk", "island").agg(F.count_if("hit").alias("run"))
    # island 0 starts the chunk; the highest island ends it
    chunks = runs.groupBy("entity", "chunk").agg(
        F.max("run").alias("best"),
        F.max(F.when(F.col("island") == 0, F.col("run"))).alias("head"),
        F.max_by("run", "island").alias("tail"),
        (F.max("island") == 0).alias("whole"),
    )
    ordered = W.partitionBy("entity").orderBy("chunk")
    carried = chunks.withColumn(
        "stretch", F.sum((~F.col("whole")).cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    )
    within = W.partitionBy("entity", "stretch").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    carried = carried.withColumn("carry", F.sum("tail").over(within))
    joined = carried.withColumn(
        "bridged", F.coalesce(F.lag("carry").over(ordered), F.lit(0)) + F.coalesce("head", F.lit(0))
    )
    return joined.groupBy("entity").agg(
        F.max_by("carry", "chunk").alias("current"),
        F.max(F.greatest("best", "bridged")).alias("longest"),
    ).withColumnRenamed("entity", entity)
