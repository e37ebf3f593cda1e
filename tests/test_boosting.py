"""Second-order boosting against a plain definition, and its defined cases."""

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskgrain.operators.boosting import BoostedTrees, BoostedTreesModel, Booster, _merged_cells
from riskgrain.operators.training import classifier, importances, logged_run
from riskgrain.sources.runs import load_model


def plain_boost(x, y, w, rounds, depth, step=0.3, l2=1.0, least=1.0):
    """Margins after each round; every distinct value but the largest is an edge."""
    edges = [sorted(set(c))[:-1] for c in zip(*x)]
    margin, history = [0.0] * len(y), []

    def grow(rows, g, h, level):
        total_g, total_h = sum(g[r] for r in rows), sum(h[r] for r in rows)
        best = (0.0, None)
        if level < depth:
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    left = [r for r in rows if x[r][f] <= cut]
                    gl, hl = sum(g[r] for r in left), sum(h[r] for r in left)
                    if 0 < len(left) < len(rows) and round(hl, 9) >= least and round(total_h - hl, 9) >= least:
                        gain = round(gl ** 2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g ** 2 / (total_h + l2), 9)
                        if gain > best[0]:
                            best = (gain, (f, cut, left))
        if best[1] is None:
            for r in rows:
                margin[r] += -step * total_g / (total_h + l2)
            return
        f, cut, left = best[1]
        grow(left, g, h, level + 1)
        grow([r for r in rows if r not in set(left)], g, h, level + 1)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grow(list(range(len(y))), [wi * (pi - yi) for wi, pi, yi in zip(w, p, y)], [wi * pi * (1 - pi) for wi, pi in zip(w, p)], 0)
        history.append(list(margin))
    return history


def study(n=160, seed=3):
    rng = random.Random(seed)
    x = [[float(rng.randrange(12)), float(rng.randrange(3)), round(rng.random(), 1)] for _ in range(n)]
    y = [int(a + 3 * b + 4 * c + rng.gauss(0, 2) > 9) for a, b, c in x]
    return x, y, [float(rng.choice([1, 1, 2])) for _ in y]


def as_table(spark, x, y, w):
    return spark.createDataFrame(
        [(k, r, int(t), v, k % 3) for k, (r, t, v) in enumerate(zip(x, y, w))], "id long, features array<double>, label int, w double, fold int")


def with_vectors(df):
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector("features"))


@pytest.mark.parametrize("depth, weighted", [(1, False), (3, True)])
def test_margins(spark, depth, weighted):
    x, y, w = study()
    w = w if weighted else [1.0] * len(y)
    model = BoostedTrees(maxIter=6, maxDepth=depth, weightCol="w").fit(with_vectors(as_table(spark, x, y, w)))
    found = {r["id"]: r["m"] for r in model.transform(with_vectors(as_table(spark, x, y, w))).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    want = plain_boost(x, y, w, 6, depth)[-1]
    assert all(abs(found[k] - m) < 1e-9 for k, m in enumerate(want))


def test_folds_grow_side_by_side(spark):
    """Every fold's margins are those of a model trained without it, on both sides of a rewrite."""
    x, y, _ = study(90)
    rows = as_table(spark, x, y, [1.0] * 90)
    booster, seen = Booster(rows, "label", "features", 3, "fold", max_depth=2), {}
    for first in (0, 4):
        booster.grow(4)
        for r in booster.curve(first, first + 4).groupBy("m", "rounds").agg(F.sum("score").alias("s"), F.count("*").alias("n")).collect():
            seen[r["m"], r["rounds"]] = r["s"]
            assert r["n"] == 90
    for m in range(3):
        kept = [k for k in range(90) if k % 3 != m]
        model = BoostedTrees(maxIter=8, maxDepth=2).fit(with_vectors(rows.where(F.col("fold") != m)))
        whole = model.transform(with_vectors(rows)).agg(F.sum(vector_to_array("rawPrediction")[1])).first()[0]
        assert abs(whole - seen[m, 8]) < 1e-6 or len({tuple(x[k]) for k in kept}) < len(kept)
    assert len(seen) == 24


def test_missing_values_lie_below_all(spark):
    rows = [(k, [float("nan") if k % 4 == 0 else float(k % 4), None], int(k % 4 == 0), 1.0, 0) for k in range(80)]
    table = spark.createDataFrame(rows, "id long, features array<double>, label int, w double, fold int")
    booster = Booster(table, "label", "features", 1, None, max_depth=1)
    booster.grow(3)
    scores = {r["y"]: r["s"] for r in booster.curve(2, 3).groupBy("y").agg(F.collect_set(F.round("score", 9)).alias("s")).collect()}
    assert len(scores[0.0]) == len(scores[1.0]) == 1 and scores[1.0][0] > 0 > scores[0.0][0]


def test_degenerate_tables(spark):
    """No rows, one class, constant features: trees without splits."""
    for rows in ([], [(1, [1.0], 1, 1.0, 0)] * 5, [(k, [2.0], k % 2, 1.0, 0) for k in range(10)]):
        table = with_vectors(spark.createDataFrame(rows, "id long, features array<double>, label int, w double, fold int"))
        model = BoostedTrees(maxIter=2, maxDepth=2).fit(table)
        assert model.split_table() == [] and model.transform(table).count() == len(rows)


def test_merged_cells_have_equal_hessian():
    import numpy as np

    merged = _merged_cells(np.array([1.0] * 50 + [50.0] + [1.0] * 50), 10)
    sums = np.bincount(merged, np.array([1.0] * 50 + [50.0] + [1.0] * 50))
    assert len(sums) <= 10 and (np.diff(merged) >= 0).all() and sorted(sums)[-2] <= 16
    assert list(_merged_cells(np.array([3.0, 0.0, 1.0]), 4)) == [0, 1, 2]


def test_stored_model_and_importances(spark, tmp_path):
    x, y, w = study(120)
    table = with_vectors(as_table(spark, x, y, w))
    model = classifier("xgboost", maxIter=3, maxDepth=2).fit(table)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = BoostedTreesModel.load(f"{tmp_path}/model")
    assert [r[0] for r in again.transform(table).select("probability").collect()] == [r[0] for r in model.transform(table).select("probability").collect()]
    found = {r["feature"]: r for r in importances(model, ["a", "b", "c"]).collect()}
    assert sum(r["weight"] for r in found.values()) == len(model.split_table()) and all((r["gain"] > 0) == (r["weight"] > 0) for r in found.values())
    run = logged_run(table, "id", "label", "xgboost", 1, {"test": 20, "train": 60, "val": 20}, str(tmp_path), maxIter=2, maxDepth=2)
    assert load_model(f"{tmp_path}/models/{run}").transform(table).count() == 120
