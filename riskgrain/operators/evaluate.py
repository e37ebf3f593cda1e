"""Evaluation of scores and predictions against a 0/1 truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import flag, number, ratio
from ..plans.order_stats import bucket_ends, filled_buckets, ranks_by_size, with_slot
from ..plans.prefix import running_totals
from ..session import literal

KS_BINS = 20
ALL = "all"


def scored(df: DataFrame, label: str, score: str, true_value=1, by: str | None = None) -> DataFrame:
    """Rows ``(subset, y, score)`` with both label and score present."""
    subset = F.lit(ALL) if by is None else F.col(by).cast("string")
    rows = df.select(subset.alias("subset"), F.col(label).alias("_l"), number(score).alias("score"))
    rows = rows.where("_l is not null and score is not null and subset is not null")
    return rows.select("subset", flag("_l", true_value).alias("y"), "score")


def _threshold_table(rows: DataFrame, thresholds: dict[str, Sequence[float]]) -> DataFrame:
    """TPR and FPR per subset and threshold from one pass over the rows.

    Each row is counted in the slot between two neighbouring thresholds; running
    sums over the few slots do the rest.
    """
    spark = rows.sparkSession
    descending = {s: sorted(set(ths), reverse=True) for s, ths in thresholds.items()}
    known = [(s, len(ths) - i, t) for s, ths in descending.items() for i, t in enumerate(ths)]
    negated = F.create_map(
        *[c for s, ths in descending.items() for c in (F.lit(s), F.array(*[F.lit(-t) for t in ths]))]
    )
    placed = rows.select(
        "subset", "y", (-F.col("score")).alias("_x"), F.try_element_at(negated, F.col("subset")).alias("_edges")
    )
    most = max(len(ths) for ths in descending.values())
    placed = with_slot(placed, "_x", F.col("_edges"), F.size("_edges"), most, "_above")
    placed = placed.select("subset", "y", (F.size("_edges") - F.col("_above")).alias("slot"))
    cells = placed.groupBy("subset", "slot").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    grid = literal(spark, known, "subset string, slot int, threshold double")
    # one row per slot: the number of thresholds, plus one, per subset
    above = W.partitionBy("subset").orderBy(F.col("slot").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("subset")
    filled = (
        cells.join(grid, ["subset", "slot"], "full_outer")
        .withColumns({"p": F.coalesce("p", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
        .withColumns(
            {
                "tp": F.sum("p").over(above), "fp": F.sum("n").over(above),
                "_p": F.sum("p").over(whole), "_n": F.sum("n").over(whole),
            }
        )
    )
    return filled.where("threshold is not null").select(
        "subset", "threshold", "tp", "fp",
        ratio(F.col("tp"), F.col("_p")).alias("tpr"), ratio(F.col("fp"), F.col("_n")).alias("fpr"),
    )


def threshold_rates(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float], true_value=1
) -> DataFrame:
    """TPR and FPR when a row counts as positive at ``score >= threshold``."""
    rows = scored(df, label, score, true_value)
    return _threshold_table(rows, {ALL: [float(t) for t in thresholds]}).drop("subset")


def _ks_points(rows: DataFrame, n_bin: int) -> DataFrame:
    _, found = ranks_by_size(
        rows.select(F.col("subset").alias("k"), F.col("score").alias("v")),
        lambda n: bucket_ends(n, min(n_bin, n)), [(i + 1) / n_bin for i in range(n_bin)],
    )
    return _threshold_table(rows, {k: [v.value for v in at.values()] for k, at in found.items()})


def ks_points(df: DataFrame, label: str, score: str, n_bin: int = KS_BINS, true_value=1) -> DataFrame:
    """TPR and FPR at the last score of each of ``n_bin`` equal-count buckets."""
    return _ks_points(scored(df, label, score, true_value), n_bin).drop("subset")


def ks(
    df: DataFrame, label: str, score: str, n_bin: int = KS_BINS, true_value=1, by: str | None = None
) -> DataFrame:
    """Largest TPR - FPR over the bucket thresholds; one row, or one per ``by``."""
    rows = scored(df, label, score, true_value, by)
    if by is not None:
        return _ks_by(rows, n_bin).withColumnRenamed("subset", by)
    points = _ks_points(rows, n_bin)
    result = points.groupBy("subset").agg(F.abs(F.max(F.col("tpr") - F.col("fpr"))).alias("ks"))
    return result.select("ks")


def _ks_by(rows: DataFrame, n_bin: int) -> DataFrame:
    """KS of any number of subsets: running totals tell which scores end a bucket and the rates from there on."""
    totals = running_totals(
        rows, "score", {"p": F.sum("y"), "n": F.sum(1 - F.col("y"))}, ["subset"])
    sizes = totals.groupBy(F.col("subset").alias("_s")).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    placed = totals.join(sizes, F.col("subset") == F.col("_s"))
    size = F.col("all_p") + F.col("all_n")
    upto = F.col("cum_p") + F.col("cum_n")
    k = F.least(F.lit(n_bin), size)
    ends = filled_buckets(upto, size, k) > filled_buckets(upto - F.col("p") - F.col("n"), size, k)
    tpr = ratio(F.col("all_p") - F.col("cum_p") + F.col("p"), F.col("all_p"))
    fpr = ratio(F.col("all_n") - F.col("cum_n") + F.col("n"), F.col("all_n"))
    return placed.where(ends).groupBy("subset").agg(F.abs(F.max(tpr - fpr)).alias("ks"))


def _score_totals(rows: DataFrame, **options) -> DataFrame:
    sums = {"p": F.sum("y"), "n": F.sum(1 - F.col("y"))}
    return running_totals(rows, "score", sums, ["subset"], **options)


def auc(df: DataFrame, label: str, score: str, true_value=1, by: str | None = None, **options) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null without both classes."""
    totals = _score_totals(scored(df, label, score, true_value, by), **options)
    wins = F.col("p") * (F.col("cum_n") - F.col("n") + F.col("n") / 2)
    result = totals.groupBy("subset").agg(
        ratio(F.sum(wins), F.sum("p").cast("double") * F.sum("n")).alias("auc")
    )
    return result.select("auc") if by is None else result.withColumnRenamed("subset", by)


def roc_points(df: DataFrame, label: str, score: str, true_value=1, **options) -> DataFrame:
    """ROC curve: one point per distinct score, thresholds descending from +inf at (0, 0)."""
    rows = scored(df, label, score, true_value)
    totals = _score_totals(rows, **options)
    sizes = totals.agg(
        F.struct(F.sum("p").alias("p"), F.sum("n").alias("n")).alias("t")
    ).scalar()
    points = totals.select("score", "p", "n", "cum_p", "cum_n", sizes.alias("t")).select(
        F.col("score").alias("threshold"),
        ratio(F.col("t.p") - F.col("cum_p") + F.col("p"), F.col("t.p")).alias("tpr"),
        ratio(F.col("t.n") - F.col("cum_n") + F.col("n"), F.col("t.n")).alias("fpr"),
    )
    start = literal(df.sparkSession, [(float("inf"), 0.0, 0.0)], "threshold double, tpr double, fpr double")
    return start.unionByName(points)


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the ratios made from them, in one aggregation."""
    y, q = F.col(label), F.col(pred)
    rows = df.where(y.isNotNull() & q.isNotNull())
    counts = rows.groupBy(*by).agg(
        F.count_if((y == 1) & (q == 1)).alias("tp"), F.count_if((y == 0) & (q == 1)).alias("fp"),
        F.count_if((y == 0) & (q == 0)).alias("tn"), F.count_if((y == 1) & (q == 0)).alias("fn"),
        F.count("*").alias("total"), F.count_if(y == 1).alias("_yes"), F.count_if(y == 0).alias("_no"),
        F.count_if(q == 1).alias("_said"),
    )
    tp, fp, tn, fn, total = (F.col(c) for c in ("tp", "fp", "tn", "fn", "total"))
    recall = ratio(tp, F.col("_yes"))
    return counts.select(
        *by, "tp", "fp", "tn", "fn", "total",
        ratio(tp + tn, total).alias("accuracy"),
        ratio(fp + fn, total).alias("misclassification"),
        recall.alias("true_positive_rate"), recall.alias("sensitivity"), recall.alias("recall"),
        ratio(fp, F.col("_no")).alias("false_positive_rate"),
        ratio(tn, F.col("_no")).alias("specificity"),
        ratio(tp, F.col("_said")).alias("precision"),
        ratio(F.col("_yes"), total).alias("prevalence"),
    )


def accuracy(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return confusion(df, label, pred, by).select(*by, "accuracy")


def metric_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per metric column."""
    long = results.unpivot(list(by), list(metrics), "metric", "v")
    return long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def split_performance(
    results: DataFrame, splits: Sequence[str] = ("train", "val", "test"), metrics: Sequence[str] = ("auc", "ks", "acc")
) -> DataFrame:
    """Mean of every metric per split: rows are metrics, columns are splits."""
    long = results.unpivot(["split"], list(metrics), "metric", "v")
    return long.groupBy("metric").pivot("split", list(splits)).agg(F.avg("v"))


def _ends_upto(x: Column, n: Column, k: Column) -> Column:
    """How many of ``k`` near-equal runs of ``n`` rows end at or before row ``x``."""
    size, longer = F.floor(n / k), n % k
    head = longer * (size + 1)
    return F.when(x <= head, F.floor(x / (size + 1))).otherwise(longer + F.floor((x - head) / size))


def evaluation(
    df: DataFrame, label: str, score: str, pred: str | None = None, by: str | None = None, n_bin: int = KS_BINS,
    true_value=1, **options,
) -> DataFrame:
    """AUC, KS and (with predictions) accuracy, per ``by`` value or overall.

    AUC needs the running totals over the ordered scores, and those also hold
    the rates at the KS thresholds: one pass gives all measures.
    """
    subset = F.lit(ALL) if by is None else F.col(by).cast("string")
    right = F.lit(None).cast("bigint") if pred is None else (F.col(label) == F.col(pred)).cast("int")
    rows = df.select(subset.alias("subset"), F.col(label).alias("_l"), number(score).alias("score"), right.alias("right"))
    rows = rows.where("_l is not null and score is not null and subset is not null")
    rows = rows.select("subset", "score", "right", flag("_l", true_value).alias("y"))
    sums = {"p": F.sum("y"), "n": F.sum(1 - F.col("y")), "r": F.sum("right"), "judged": F.count("right")}
    result = _measures(running_totals(rows, "score", sums, ["subset"], **options), n_bin, by is None)
    if pred is None:
        result = result.drop("acc")
    return result.withColumnRenamed("subset", by or "subset")


def measures_of_counts(counts: DataFrame, n_bin: int = KS_BINS) -> DataFrame:
    """``(subset, auc, ks)`` of counted rows ``(subset, score, p, n)``: ``p`` positives and ``n`` negatives of a score."""
    none = F.lit(None).cast("bigint")
    sums = {"p": F.sum("p"), "n": F.sum("n"), "r": F.sum(none), "judged": F.count(none)}
    return _measures(running_totals(counts, "score", sums, ["subset"]), n_bin, False).drop("acc")


def _measures(totals: DataFrame, n_bin: int, single: bool) -> DataFrame:
    """``(subset, auc, ks, acc)`` from running totals; ``single``: of one subset only."""
    sizes = totals.groupBy("subset").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    points = totals.join(F.broadcast(sizes) if single else sizes, "subset")
    last, own, size = F.col("cum_p") + F.col("cum_n"), F.col("p") + F.col("n"), F.col("_p") + F.col("_n")
    k = F.least(F.lit(n_bin), size)
    is_threshold = _ends_upto(last, size, k) > _ends_upto(last - own, size, k)
    tpr = ratio(F.col("_p") - F.col("cum_p") + F.col("p"), F.col("_p"))
    fpr = ratio(F.col("_n") - F.col("cum_n") + F.col("n"), F.col("_n"))
    wins = F.col("p") * (F.col("cum_n") - F.col("n") + F.col("n") / 2)
    return points.groupBy("subset").agg(
        ratio(F.sum(wins), F.max("_p").cast("double") * F.max("_n")).alias("auc"),
        F.abs(F.max(F.when(is_threshold, tpr - fpr))).alias("ks"),
        ratio(F.sum("r"), F.sum("judged")).alias("acc"),
    )
