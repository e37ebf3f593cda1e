"""Dense daily and monthly counts with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import month_key


def _dense(counts: DataFrame, key: str, step: str) -> DataFrame:
    """Fill the gaps of a counted calendar.  Its length is the calendar's, not the data's."""
    limits = counts.agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a is not null")
    spine = limits.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {step}"))).alias(key))
    return spine.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def _running(dense: DataFrame, key: str) -> DataFrame:
    # at most one row per calendar day, so one task is enough
    order = W.orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return dense.withColumn("cumulative", F.sum("n").over(order))


def daily_counts(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per calendar day between the first and last day, gaps as 0."""
    day = F.to_date(date_col)
    counts = df.where(day.isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return _dense(counts, "day", "day")


def daily_cumulative(df: DataFrame, date_col: str) -> DataFrame:
    """Daily counts with their running total."""
    return _running(daily_counts(df, date_col), "day")


def monthly_counts(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per month ``yyyymm`` between the first and last month, gaps as 0."""
    month = F.to_date(F.date_trunc("month", date_col))
    counts = df.where(month.isNotNull()).groupBy(month.alias("first_day")).agg(F.count("*").alias("n"))
    return _dense(counts, "first_day", "month").select(month_key("first_day").alias("month"), "n")


def monthly_cumulative(df: DataFrame, date_col: str) -> DataFrame:
    """Monthly counts with their running total."""
    return _running(monthly_counts(df, date_col), "month")
