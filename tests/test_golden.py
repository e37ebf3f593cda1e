"""Worked examples with values found by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from riskgrain.functions import haversine_km, interval_ends, key_date, shift_months
from riskgrain.operators import binning, calendar, edges, evaluate, profile, response, sampling, streaks, tree, resample
from riskgrain.operators.keywords import keyword_appearance
from riskgrain.session import literal

X = [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
Y = [0, 0, 0, 1, 0, 0, 1, 0, 1, 1, 1, 0]
SCORES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
TRUTH = [0, 0, 0, 1, 0, 1, 1, 1]


def column(spark, values, kind="double", name="x"):
    return literal(spark, [(i, None if v is None else float(v) if kind == "double" else v) for i, v in enumerate(values)],
                   f"id bigint, {name} {kind}")


def xy(spark):
    return literal(spark, [(i, float(x), y) for i, (x, y) in enumerate(zip(X, Y))], "id bigint, x double, y int")


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_range(spark):
    assert values(profile.ranges(column(spark, [0.5, -3, 7.5, 2]), ["x"]), "min", "max") == [(-3, 7.5)]


def test_group_woe(spark):
    # a tenth of the 20 positives against a fortieth of the 40 negatives
    row = response.group_woe(column(spark, [1, 1, 0], "int", "label"), "label", 20, 40).first()
    assert row["woe"] == pytest.approx(math.log(4))
    assert row["iv"] == pytest.approx(0.075 * math.log(4))


def test_confusion(spark):
    # five positives, three of them found; five negatives, one of them taken for positive
    label = [1, 0, 1, 0, 1, 0, 1, 0, 1, 0]
    pred = [1, 1, 1, 0, 1, 0, 0, 0, 0, 0]
    row = evaluate.confusion(literal(spark, list(zip(label, pred)), "label int, pred int"), "label", "pred").first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (3, 1, 4, 2)
    assert (row["accuracy"], row["recall"], row["false_positive_rate"]) == (0.7, 0.6, 0.2)
    assert row["precision"] == 0.75 and row["prevalence"] == 0.5


def test_confusion_without_positives_is_null(spark):
    row = evaluate.confusion(literal(spark, [(0, 0)], "label int, pred int"), "label", "pred").first()
    assert row["recall"] is None and row["precision"] is None and row["accuracy"] == 1.0


def test_key_date(spark):
    keys = ["110002016072704101", "2016072704101", "123", None, "1100020161399xxxxx", "20161399xxxxx"]
    got = [r[0] for r in literal(spark, [(k,) for k in keys], "k string").select(key_date("k")).collect()]
    assert got == [datetime.date(2016, 7, 27)] * 2 + [None] * 4


def test_months_clip(spark):
    df = literal(spark, [(datetime.date(2020, 1, 31),)], "d date")
    assert df.select(shift_months("d", 1)).first()[0] == datetime.date(2020, 2, 29)


def test_equal_width_edges(spark):
    df = column(spark, [1, 2, 3, 4, 5, 6, 6, 6, 6, 6, 6])
    assert edges.even_width(df, "x", 3).points == pytest.approx((1, 8 / 3, 13 / 3, 6))
    assert edges.even_width(df, "x", 3, precision=3).points == (0.995, 2.667, 4.333, 6.0)


def test_range_policy(spark):
    e = edges.outer(edges.explicit([0, 50, 100]), span=(0, 100), edge="range")
    assert e.points == (-0.5, 50, 100.5)
    assert edges.outer(edges.explicit([0, 50, 100]), left=7, edge="inf").points == (-math.inf, 50, math.inf)


def test_explicit_bins_leave_out_lowest(spark):
    binned = binning.assign_bins(column(spark, [0, 1, 2, None, float("nan"), 3]), "x", [0, 1, 2])
    assert values(binned, "bin_id") == [(-1,), (0,), (1,), (-1,), (-1,), (-1,)]


def test_disordered_breakpoints_raise():
    with pytest.raises(ValueError):
        edges.explicit([0, 2, 1])
    with pytest.raises(ValueError):
        edges.explicit([0, 1], minimum=3)


def test_constant_column(spark):
    df = column(spark, [5, 5, 5])
    for e in (edges.even_width(df, "x", 4), edges.even_depth(df, "x", 4)):
        binned = binning.assign_bins(df, "x", e).select("bin_id").distinct().collect()
        assert len(binned) == 1 and binned[0][0] >= 0


def test_empty_bins_merge_upwards(spark):
    df = column(spark, [0, 1, 9, 10])
    assert edges.breakpoints(df, "x", n=5).points == (0, 2, 10)


def test_ntile_sizes(spark):
    sizes = binning.even_buckets(column(spark, range(10)), "x", "id", 3).groupBy("bucket").count().orderBy("bucket")
    assert values(sizes, "count") == [(4,), (3,), (3,)]


@pytest.mark.parametrize(
    "metric, score", [("woe", 2.302585), ("iv", 1.184187), ("gini", 0.180556), ("entropy", 0.135656)]
)
def test_best_split(spark, metric, score):
    row = tree.split_feature(xy(spark), ["x"], "y", metric).first()
    assert row["bp"] == 3 and row["score"] == pytest.approx(score, abs=1e-6)


def test_pure_split_only_when_allowed(spark):
    df = literal(spark, [(float(x), int(x > 4)) for x in range(1, 9)], "x double, y int")
    assert tree.split_feature(df, ["x"], "y", "iv").collect() == []
    assert tree.split_feature(df, ["x"], "y", "iv", allow_pure=True).first()["bp"] == 4


def test_tree_parameters_are_checked(spark):
    for bad in ({"max_depth": 0}, {"min_leaf_size": 12}, {"min_split_size": 0}, {"metric": "variance"}):
        with pytest.raises(ValueError):
            tree.grow_tree(xy(spark), ["x"], "y", **bad)


def test_entropy_and_gini(spark):
    row = response.class_measures(xy(spark), "y").first()
    assert row["entropy"] == pytest.approx(0.679193, abs=1e-6) and row["gini"] == pytest.approx(0.486111, abs=1e-6)


def test_smoothed_woe(spark):
    df = xy(spark).withColumn("bin", (F.col("x") > 3).cast("int"))
    rows = {r["bin"]: r for r in response.smoothed_woe(df, "y", "bin").collect()}
    assert rows["0"]["woe"] == pytest.approx(-0.847298, abs=1e-6) and rows["1"]["woe"] == pytest.approx(0.762140, abs=1e-6)
    assert rows["0"]["iv_total"] == pytest.approx(0.613119, abs=1e-6)


def test_tukey_fences(spark):
    assert profile.outlier_fences(column(spark, [1, 2, 3, 4, 100]), "x") == (-1, 7)


@pytest.mark.parametrize("hits, want", [([1, 1, 0, 1, 1, 1, 0, 1], (1, 3)), ([0, 0], (0, 0)), ([1], (1, 1))])
@pytest.mark.parametrize("chunk_rows", [1, 3, 100])
def test_streak(spark, hits, want, chunk_rows):
    df = literal(spark, [("a", i, h) for i, h in enumerate(hits)], "e string, t int, h int")
    assert values(streaks.streaks(df, "e", "t", F.col("h") == 1, chunk_rows), "current", "longest") == [want]


def scored(spark):
    return literal(spark, list(zip(TRUTH, SCORES)), "y int, s double")


def test_ks(spark):
    points = evaluate.ks_points(scored(spark), "y", "s", 4).orderBy("threshold").collect()
    assert [r["threshold"] for r in points] == [0.2, 0.4, 0.6, 0.8]
    assert [r["tpr"] - r["fpr"] for r in points] == pytest.approx([0.25, 0.75, 0.75, 0.25])
    assert evaluate.ks(scored(spark), "y", "s", 4).first()[0] == pytest.approx(0.75)


def test_auc_and_evaluation_agree(spark):
    assert evaluate.auc(scored(spark), "y", "s").first()[0] == pytest.approx(0.9375)
    both = evaluate.evaluation(scored(spark).withColumn("p", F.lit(1)), "y", "s", "p", n_bin=4).first()
    assert (both["auc"], both["ks"], both["acc"]) == pytest.approx((0.9375, 0.75, 0.5))


def test_one_class_gives_null_auc(spark):
    df = literal(spark, [(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()[0] is None


def test_dense_days_and_months(spark):
    day = datetime.date
    df = literal(spark, [(day(2020, 1, 1),), (day(2020, 1, 1),), (day(2020, 1, 3),), (None,)], "d date")
    assert values(calendar.daily_cumulative(df, "d").orderBy("day"), "n", "cumulative") == [(2, 2), (0, 2), (1, 3)]
    df = literal(spark, [(day(2019, 12, 5),), (day(2020, 2, 1),)], "d date")
    assert values(calendar.monthly_counts(df, "d").orderBy("month"), "month", "n") == [(201912, 1), (202001, 0), (202002, 1)]


def test_stratified_size():
    assert sampling.stratum_sizes(10, 0.3) == (3, 7)
    assert sampling.stratum_sizes(2, 0.01) == (1, 1)


def test_undersample_size(spark):
    df = literal(spark, [(i, int(i < 20)) for i in range(100)], "id bigint, y int")
    got = resample.undersample(df, "id", "y", 0.5).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 20, 0: 40}


def test_keyword_everywhere_has_no_absent_rate(spark):
    df = literal(spark, [(1, 0, 1, "good tea"), (1, 1, 0, None), (1, 0, None, "tea")], "w_tea int, w_x int, label int, note string")
    rows = {r["keyword"]: r for r in keyword_appearance(df, ["note"], ["tea", "x"], prefix="w_").collect()}
    assert rows["tea"]["present_bad_rate"] == pytest.approx(1 / 3) and rows["tea"]["absent_bad_rate"] is None
    assert rows["tea"]["note"] == 2
    assert rows["x"]["present_bad_rate"] == 0 and rows["x"]["absent_bad_rate"] == 0.5 and rows["x"]["note"] == 0


def test_interval_labels(spark):
    df = literal(spark, [("(0.5, 2]",), ("(-inf, 3.25]",), ("missing",), ("nan",)], "t string")
    lo, hi = interval_ends("t")
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(0.5, 2.0), (-math.inf, 3.25), (None, None), (None, None)]


def test_haversine(spark):
    # a quarter of the equator
    d = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).first()[0]
    assert d == pytest.approx(math.pi * 6371.0088 / 2)
    assert spark.range(1).select(haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(9.0))).first()[0] is None


def test_grouping_must_match_categories(spark):
    df = literal(spark, [("a",), ("b",)], "c string")
    with pytest.raises(ValueError):
        binning.bin_categorical(df, "c", {"g": ["a"]})
    with pytest.raises(ValueError):
        binning.bin_categorical(df, "c", {"g": ["a", "b", "z"]})
    assert sorted(values(binning.bin_categorical(df, "c", {"g": ["a"], "h": ["b"]}), "bin")) == [("g",), ("h",)]


def test_step_distribution(spark):
    rows = profile.step_distribution(column(spark, [1, 1, 2.5, 4]), "x").orderBy("p")
    assert values(rows, "p", "n", "cumulative") == [(1, 2, 2), (2, 0, 2), (3, 1, 3), (4, 1, 4)]


def test_monotone_bins_fill_missing_with_median(spark):
    df = literal(spark, [(float(i) if i != 5 else None, int(i >= 6)) for i in range(12)], "x double, y int")
    e, table = binning.monotone_bins(df, "x", "y", n=4)
    rates = [r["rate"] for r in table.orderBy("bin_id").collect()]
    assert rates == sorted(rates) and sum(r["total"] for r in table.collect()) == 12
