"""Profiles of columns: ranges, nulls, lengths, outliers, box plots and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import number, ratio
from ..plans.order_stats import LITERAL_KEYS, quantile_table, quantiles, quantiles_by_key
from ..session import literal

FENCE = 1.5
STEP_BLOCK = 100_000
#: Bandwidths beyond which a kernel counts as 0.
KERNEL_REACH = 7.0


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column."""
    long = df.select(*[number(c).alias(c) for c in columns]).unpivot([], list(columns), "feature", "v")
    return long.groupBy("feature").agg(F.min("v").alias("min"), F.max("v").alias("max"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls (and NaN) per column, counted in one pass."""
    columns = list(columns or df.columns)
    floating = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    checks = {
        c: F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull() for c in columns
    }
    counted = df.agg(*[F.count_if(test).alias(c) for c, test in checks.items()])
    return counted.unpivot([], columns, "feature", "n_null")


def length_histogram(df: DataFrame, col: str) -> DataFrame:
    """Rows per text length; a null counts as the empty text of length 0."""
    return df.groupBy(F.coalesce(F.length(F.col(col).cast("string")), F.lit(0)).alias("length")).agg(
        F.count("*").alias("n")
    )


def fences(q1: float, q3: float) -> tuple[float, float]:
    return q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)


def outlier_fences(df: DataFrame, col: str, exact: bool = True) -> tuple[float, float]:
    """Tukey fences of a column."""
    q1, q3 = quantiles(df, {"v": number(col)}, [0.25, 0.75], exact=exact)["v"]
    if q1 is None:
        raise ValueError(f"{col} has no values")
    return fences(q1, q3)


def flag_outliers(df: DataFrame, col: str, out: str = "is_outlier", exact: bool = True) -> DataFrame:
    """Mark the rows outside the fences; null values give null."""
    low, high = outlier_fences(df, col, exact)
    v = number(col)
    return df.withColumn(out, (v < F.lit(low)) | (v > F.lit(high)))


def labels_of(df: DataFrame, label: str, most: int = LITERAL_KEYS) -> list | None:
    """The distinct non-null labels of a table, sorted; None if there are more than ``most``."""
    rows = df.select(label).where(F.col(label).isNotNull()).distinct().limit(most + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= most else None


def box_summary(
    df: DataFrame, features: Sequence[str], label: str, exact: bool = True
) -> DataFrame:
    """Quartiles, whiskers and outlier count per feature and label.

    Whiskers are the outermost values inside the fences.  The cut-offs of few
    labels are searched for; those of many are a table made by running counts.
    """
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    long = df.select(F.col(label).alias("label"), *[number(f).alias(f) for f in features]).unpivot(
        "label", list(features), "feature", "v"
    ).where("v is not null and label is not null")
    labels = labels_of(df, label)
    if labels is None:
        cut = quantile_table(long.select(F.struct("feature", "label").alias("k"), "v"), [0.25, 0.5, 0.75])
        q1, q3 = F.col("q")[0], F.col("q")[2]
        known = cut.select(
            "k.feature", "k.label", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"),
            (q1 - FENCE * (q3 - q1)).alias("lower"), (q3 + FENCE * (q3 - q1)).alias("upper"))
    else:
        keyed = {f"{f}\u0001{v}": (f, v) for f in features for v in labels}
        rows = long.select(F.concat_ws("\u0001", "feature", F.col("label").cast("string")).alias("k"), "v")
        quartiles = quantiles_by_key(rows, [0.25, 0.5, 0.75], exact=exact)
        known = literal(
            spark, [(*keyed[k], q1, q2, q3, *fences(q1, q3)) for k, (q1, q2, q3) in quartiles.items()],
            f"feature string, label {label_type}, q1 double, median double, q3 double, lower double, upper double",
        )
    return (
        long.join(known, ["feature", "label"])
        .groupBy("feature", "label")
        .agg(
            F.count("*").alias("n"),
            F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
            F.min(F.when(F.col("v") >= F.col("lower"), F.col("v"))).alias("whisker_low"),
            F.max(F.when(F.col("v") <= F.col("upper"), F.col("v"))).alias("whisker_high"),
            F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("n_outliers"),
        )
    )


def step_distribution(
    df: DataFrame, col: str, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Rows per unit step and cumulative count for p = start, start + 1, ... <= end.

    ``n`` counts the rows in ``(p - 1, p]``; the first row takes all values up to start.
    """
    v = number(col)
    limits = df.agg(
        F.coalesce(F.lit(start).cast("double"), F.min(v)).alias("a"),
        F.coalesce(F.lit(end).cast("double"), F.max(v)).alias("b"),
    ).select("a", "b", F.floor(F.col("b") - F.col("a")).alias("steps")).first()
    if limits["a"] is None or limits["steps"] < 0:
        return literal(df.sparkSession, [], "p double, n bigint, cumulative bigint")
    step = F.greatest(F.ceil(v - F.lit(limits["a"])), F.lit(0)).cast("bigint")
    counts = df.where(v <= F.lit(limits["b"])).groupBy(step.alias("k")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(limits["steps"] + 1).withColumnRenamed("id", "k")
    dense = spine.join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    # blocks of steps are summed on their own, then shifted by the blocks before them
    blocks = dense.withColumn("block", F.floor(F.col("k") / STEP_BLOCK))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shifts = blocks.groupBy("block").agg(F.sum("n").alias("t")).select("block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("shift"))
    inside = W.partitionBy("block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    summed = blocks.withColumn("upto", F.sum("n").over(inside)).join(shifts, "block")
    return summed.select(
        (F.lit(limits["a"]) + F.col("k")).alias("p"), "n", (F.col("upto") + F.col("shift")).cast("bigint").alias("cumulative"))


def histograms(df: DataFrame, features: Sequence[str], bins: int = 20, density: bool = False) -> DataFrame:
    """Equal-width histogram per feature with max(``bins``, distinct count) bins.

    Bins are closed on the left, the last one on both sides; empty bins are not
    listed.  ``density`` adds count / (rows * width).
    """
    features = list(features)
    rows = df.select(*[number(f).alias(f) for f in features])
    long = rows.unpivot([], features, "feature", "v").where("v is not null")
    values = long.groupBy("feature", "v").agg(F.count("*").alias("k"))
    shape = values.groupBy("feature").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.greatest(F.lit(bins), F.count("*")).alias("n_bins"),
        F.sum("k").alias("total"),
    ).select(
        "feature", "n_bins", "total",
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("n_bins"))
    # one row per feature, and features are columns
    placed = values.join(F.broadcast(shape), "feature").withColumn(
        "bin_id", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.col("n_bins") - 1)
    )
    result = placed.groupBy("feature", "bin_id", "lo", "width", "n_bins", "total").agg(F.sum("k").alias("n")).select(
        "feature", "bin_id", "n_bins",
        (F.col("lo") + F.col("bin_id") * F.col("width")).alias("left"),
        (F.col("lo") + (F.col("bin_id") + 1) * F.col("width")).alias("right"),
        "n",
        ratio(F.col("n"), F.col("total") * F.col("width")).alias("density"),
    )
    return result if density else result.drop("density")


def density_curve(df: DataFrame, col: str, points: int = 100, cut: float = 3.0, fine: int = 256) -> DataFrame:
    """``(point, x, density)``: a Gaussian kernel density at ``points`` equal steps, ``cut`` bandwidths beyond the ends.

    The bandwidth is ``1.059 * s / n ** 0.2`` with ``s`` the smaller of the
    standard deviation and the exact quartile distance over 1.349 (the former if
    the latter is 0).  Values are dealt linearly to the two ends of cells of
    ``1 / fine`` bandwidths, so rows collapse before any kernel is computed; that
    moves a density by at most ``1 / (8 * fine ** 2)`` of a kernel's height, and
    kernels end at ``KERNEL_REACH`` bandwidths.  Nulls and NaN are left out; one
    value alone, or none, has no curve.
    """
    v = number(col)
    rows = df.select(v.alias("v")).where("v IS NOT NULL")
    spark, schema = df.sparkSession, "point int, x double, density double"
    whole = rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev("v").alias("s")).first()
    if whole["n"] < 2 or not whole["s"]:
        return literal(spark, [], schema)
    q1, q3 = quantiles(rows, {"v": F.col("v")}, [0.25, 0.75])["v"]
    spread = min(whole["s"], (q3 - q1) / 1.349) if q3 > q1 else whole["s"]
    width = 1.059 * spread / whole["n"] ** 0.2
    start, cell = whole["lo"] - cut * width, width / fine
    step = (whole["hi"] - whole["lo"] + 2 * cut * width) / max(points - 1, 1)

    place = (F.col("v") - whole["lo"]) / cell
    low = F.floor(place)
    ends = F.array(
        F.struct(low.alias("k"), (1 - (place - low)).alias("w")), F.struct((low + 1).alias("k"), (place - low).alias("w")))
    cells = rows.select(F.inline(ends)).groupBy("k").agg(F.sum("w").alias("w")).withColumn("at", whole["lo"] + F.col("k") * cell)
    reach = KERNEL_REACH * width
    first = F.greatest(F.ceil((F.col("at") - reach - start) / step), F.lit(0))
    last = F.least(F.floor((F.col("at") + reach - start) / step), F.lit(points - 1))
    # a cell far from all points reaches none
    met = cells.where(first <= last).select("at", "w", F.explode(F.sequence(first, last)).alias("point"))
    away = (F.col("at") - (start + F.col("point") * step)) / width
    sums = met.groupBy("point").agg(F.sum(F.col("w") * F.exp(-away * away / 2)).alias("sum"))
    return spark.range(points).withColumnRenamed("id", "point").join(sums, "point", "left").select(
        F.col("point").cast("int"), (start + F.col("point") * step).alias("x"),
        (F.coalesce("sum", F.lit(0.0)) / (whole["n"] * width * math.sqrt(2 * math.pi))).alias("density"))
