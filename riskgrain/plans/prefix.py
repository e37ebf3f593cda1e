"""Distributed running totals over an ordered value.

Rows are first collapsed to one per distinct value (map-side combined, so a hot
value never travels as many rows).  The collapsed table is written and, if it is
large, dealt by range over (groups, value) into buckets of about ``bucket_rows``
distinct values, whatever their counts and whatever the number of groups.  Each
bucket is summed on its own and the total of its group's earlier buckets is
added.  Bucket numbers are written with the rows, so a lost executor changes
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

BUCKET_ROWS = 100_000


def bucketed(hist: DataFrame, value: str, groups: Sequence[str], bucket_rows: int) -> DataFrame | None:
    """The distinct values with a column ``_bucket`` that ascends with (groups, value); None if one bucket holds them."""
    buckets = math.ceil(hist.count() / bucket_rows)
    if buckets <= 1:
        return None
    dealt = hist.repartitionByRange(buckets, *groups, value).withColumn("_bucket", F.spark_partition_id())
    return materialise(dealt, "buckets")


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    groups: Sequence[str],
    *,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per (groups, distinct value) with each sum and its running total.

    ``cum_<name>`` includes the row's own value.  Nulls of ``value`` and of the
    groups are dropped.  There may be any number of groups, of any size.
    """
    groups = list(groups)
    hist = materialise(
        df.dropna(subset=[*groups, value]).groupBy(*groups, value).agg(*[c.alias(n) for n, c in sums.items()]), "values")
    placed = bucketed(hist, value, groups, bucket_rows)
    if placed is None:
        order = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        return hist.select("*", *[F.sum(n).over(order).alias(f"cum_{n}") for n in sums])

    totals = placed.groupBy(*groups, "_bucket").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    # a row for each bucket that a group reaches
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(n).over(inside).alias(f"_i_{n}") for n in sums])
    return summed.join(offsets, [*groups, "_bucket"]).select(
        *groups, value, *sums, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(f"cum_{n}") for n in sums]
    )
