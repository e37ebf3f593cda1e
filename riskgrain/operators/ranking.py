"""The first best row, overall or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def top(df: DataFrame, score: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The row with the largest score; equal scores go to the smallest ``tie``.

    A partial aggregate picks it, so nothing is sorted and a crowded group does
    not gather in one task.
    """
    by = list(by)
    leaders = df.groupBy(*by).agg(F.max(score).alias("_best"))
    match = F.col(score) == F.col("_best")
    if by:
        leaders = leaders.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_best")
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
        level = df.join(leaders, match).select(*df.columns)
    else:
        level = df.where(F.col(score) == leaders.scalar())
    rest = [c for c in df.columns if c not in by]
    return level.groupBy(*by).agg(F.min_by(F.struct(*rest), tie).alias("_row")).select(*by, "_row.*").select(*df.columns)
