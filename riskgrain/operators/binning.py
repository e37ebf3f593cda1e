"""Bin assignment for numeric and categorical variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import number
from ..plans.order_stats import LITERAL_KEYS, ONLY, bucket_ends, bucket_of, cutoffs, filled_buckets, quantiles
from ..plans.prefix import running_totals
from ..session import literal
from .edges import Edges, breakpoints, explicit
from .recode import invert, recode


def assign_bins(df: DataFrame, col: str, edges: Edges | Sequence[float], out: str = "bin_id") -> DataFrame:
    """Add the bin of every row: a pure expression, no shuffle."""
    e = edges if isinstance(edges, Edges) else explicit(edges)
    return e.assign(df, col, out)


def bin_numeric(
    df: DataFrame, col: str, bins: Edges | Sequence[float] | int = 10, method: str = "even_width",
    out: str = "bin_id", **options,
) -> tuple[DataFrame, Edges]:
    """Bin by given breakpoints, or by ``bins`` bins of a method."""
    if isinstance(bins, int):
        e = breakpoints(df, col, method=method, n=bins, **options)
    else:
        e = bins if isinstance(bins, Edges) else explicit(bins)
    return assign_bins(df, col, e, out), e


def bin_categorical(
    df: DataFrame, col: str, groups: Mapping[str, Sequence[str]] | None = None, out: str = "bin"
) -> DataFrame:
    """Categories as bins, optionally merged into validated groups."""
    if groups is None:
        return df.withColumn(out, F.col(col).cast("string"))
    return recode(df, col, invert(groups), out)


def even_buckets(df: DataFrame, value: str, key: str, n: int, out: str = "bucket", **search) -> DataFrame:
    """1-based bucket of ``n`` near-equal runs in ``(value, key)`` order, like ``ntile``.

    Only the last row of each bucket is searched for; rows then compare against
    it, so nothing is sorted or moved.  More buckets than a plan should name are
    counted off instead: running counts rank the rows.  ``key`` must be unique and
    integral; rows without a value get no bucket.
    """
    v = number(value)
    total = df.agg(F.count(v)).first()[0]
    if n > total:
        raise ValueError(f"{n} buckets need at least {n} rows, found {total}")
    if n > LITERAL_KEYS:
        return _many_buckets(df, v, key, n, total, out)
    ends = bucket_ends(total, n)[:-1]
    rows = df.select(F.lit(ONLY).alias("k"), v.alias("v"), F.col(key).cast("bigint").alias("tie")).where("v is not null")
    found = cutoffs(rows, {ONLY: ends}, {ONLY: total}, **search)[ONLY]
    bucket = bucket_of(v, F.col(key), found) + 1
    return df.withColumn(out, F.when(v.isNotNull(), bucket).cast("int"))


def _many_buckets(df: DataFrame, v: Column, key: str, n: int, total: int, out: str) -> DataFrame:
    place = df.where(v.isNotNull()).select(F.struct(v.alias("v"), F.col(key).cast("bigint").alias("_tie")).alias("x"))
    ranked = running_totals(place, "x", {"n": F.count("*")}, [])
    buckets = ranked.select("x._tie", (filled_buckets(F.col("cum_n") - 1, F.lit(total), F.lit(n)) + 1).cast("int").alias("_bucket"))
    joined = df.join(buckets, F.col(key).cast("bigint") == F.col("_tie"), "left")
    return joined.withColumn(out, F.when(v.isNotNull(), F.col("_bucket"))).drop("_tie", "_bucket")


def monotone_bins(df: DataFrame, col: str, y: str, n: int = 20, exact: bool = True) -> tuple[Edges, DataFrame]:
    """The most equal-depth bins, at most ``n``, whose response rate is monotone.

    Missing values are filled with the median.  All candidate counts are judged
    from one pass: rows are grouped by the union of all candidate breakpoints,
    and every candidate's bins are unions of those cells.  Returns the edges and
    one row per bin.
    """
    median = quantiles(df, {"v": number(col)}, [0.5], exact=exact)["v"][0]
    if median is None:
        raise ValueError(f"{col} has no values")
    filled = df.select(F.coalesce(number(col), F.lit(median)).alias("x"), F.col(y).cast("double").alias("y"))
    fractions = sorted({i / k for k in range(1, n + 1) for i in range(k + 1)})
    at = dict(zip(fractions, quantiles(filled, {"v": F.col("x")}, fractions, exact=exact)["v"]))
    candidates = {k: sorted({at[i / k] for i in range(k + 1)}) for k in range(1, n + 1)}
    points = sorted(set(at.values()))
    if len(points) == 1:
        points = [points[0] - 0.001, points[0]]
        candidates = {1: points}
    fine = Edges(tuple(points), closed_low=True)

    cells = (
        fine.assign(filled, "x", "cell").groupBy("cell")
        .agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("sx"),
            F.sum("y").alias("sy"), F.count("y").alias("ny"), F.count("*").alias("nx"),
        )
    )
    # a cell ends at points[cell + 1]; a candidate's bin holds the cells up to its own edge
    members = [
        (k, cell, sum(1 for e in edges[1:-1] if e < points[cell + 1]))
        for k, edges in candidates.items() for cell in range(len(points) - 1)
    ]
    spark = df.sparkSession
    layout = literal(spark, members, "n_bins int, cell int, bin_id int")
    table = (
        cells.join(F.broadcast(layout), "cell")
        .groupBy("n_bins", "bin_id")
        .agg(
            F.min("lo").alias("min_x"), F.max("hi").alias("max_x"), F.sum("sy").alias("sum_y"),
            F.sum("ny").alias("total"), (F.sum("sy") / F.sum("ny")).alias("rate"),
            (F.sum("sx") / F.sum("nx")).alias("mean_x"),
        )
    )
    by = W.partitionBy("n_bins")

    def average_rank(c: str):
        same = W.partitionBy("n_bins", c)
        return F.rank().over(by.orderBy(c)) + (F.count("*").over(same) - 1) / 2

    ranked = table.withColumn("rx", average_rank("mean_x")).withColumn("ry", average_rank("rate"))
    # one bin has no correlation, which ends the search as well
    judged = ranked.groupBy("n_bins").agg(F.abs(F.corr("rx", "ry")).alias("r"), F.count("*").alias("m"))
    best = judged.where("r > 1 - 1e-9 or m = 1").agg(F.max("n_bins").alias("n_bins")).first()["n_bins"]
    chosen = candidates[best]
    return (
        Edges(tuple(chosen), closed_low=True),
        table.where(F.col("n_bins") == best).drop("n_bins", "mean_x").orderBy("bin_id"),
    )
