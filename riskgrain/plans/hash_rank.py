"""Exact ranks in hash order.

A row's hash is uniform, so its leading hex digits split any table evenly,
whatever the data looks like: no skew is possible and no boundary search is
needed.  Ranks are the position inside the prefix bucket plus the size of all
earlier buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import hash_text

BUCKET_ROWS = 1_000_000


def hash_ranked(
    df: DataFrame, key: str | Sequence[str], seed: int, by: Sequence[str] = (), rank_col: str = "rank",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the 1-based rank of every row by ``md5(key:seed)``, within ``by``.

    ``key`` must be unique.  The number of buckets follows the number of rows.
    """
    by = list(by)
    digits = max(1, math.ceil(math.log(max(1, df.count() / bucket_rows), 16)))
    rows = df.withColumn("_hash", hash_text(key, seed)).withColumn("_prefix", F.substring("_hash", 1, digits))
    sizes = rows.groupBy(*by, "_prefix").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if by:
        renamed = [F.col(b).alias(f"_by_{b}") for b in by]
        offsets = offsets.select(*renamed, F.col("_prefix").alias("_p"), "_offset")
        match = F.col("_prefix") == F.col("_p")
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    else:
        offsets = offsets.select(F.col("_prefix").alias("_p"), "_offset")
        match = F.col("_prefix") == F.col("_p")
    inside = W.partitionBy(*by, "_prefix").orderBy("_hash")
    ranked = rows.withColumn("_pos", F.row_number().over(inside))
    joined = ranked.join(offsets, match)
    return joined.select(*df.columns, (F.col("_pos") + F.col("_offset")).cast("bigint").alias(rank_col))
