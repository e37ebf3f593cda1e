"""Shapes that grow with the data: many groups, skewed values, tiny chunks and buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrain.operators import enrich, evaluate, profile, resample, sampling, streaks, tree
from riskgrain.operators.adaboost import AdaBoost
from riskgrain.plans.hash_rank import hash_ranked
from riskgrain.plans.order_stats import bucket_ends, filled_buckets, quantile_table, rank_search
from riskgrain.plans.prefix import bucketed
from riskgrain.session import literal, materialise
from riskgrain.streaming.jobs import enrich_stream


def test_buckets_of_skewed_values_stay_even(spark):
    """Nearly all rows on few values: buckets hold distinct values, so none is over twice its size."""
    n = 200_000
    v = F.when(F.col("id") % 20 > 0, F.col("id") % 950).otherwise(F.col("id") * 7)
    hist = spark.range(n).select(v.cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in bucketed(hist, "v", [], 500).groupBy("_bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 1000


def test_auc_of_very_many_groups(spark):
    rows = spark.range(60_006).select(
        (F.col("id") % 10_001).alias("g"), (F.col("id") / 10_001 % 2).cast("int").alias("y"), F.col("id").cast("double").alias("s"))
    found = evaluate.auc(rows, "y", "s", by="g", bucket_rows=7_000)
    assert found.count() == 10_001 and found.where("auc <> 6 / 9").isEmpty()
    assert evaluate.ks(rows, "y", "s", n_bin=4, by="g").count() == 10_001


def test_ks_by_group_equals_each_alone(spark):
    rng = random.Random(3)
    rows = literal(spark, [(g, rng.randrange(2), float(rng.randrange(30))) for g in range(4) for _ in range(200)], "g int, y int, s double")
    for r in evaluate.ks(rows, "y", "s", n_bin=7, by="g").collect():
        assert r["ks"] == pytest.approx(evaluate.ks(rows.where(F.col("g") == int(r["g"])), "y", "s", n_bin=7).first()[0])


def test_quantile_table(spark):
    rng = random.Random(4)
    data = {k: [float(rng.randrange(50)) for _ in range(1 + 13 * k)] for k in range(9)}
    rows = literal(spark, [(k, v) for k, vs in data.items() for v in vs], "k int, v double")
    fractions = [0, 0.1, 0.25, 0.5, 0.999, 1]
    for r in quantile_table(rows, fractions, bucket_rows=20).collect():
        assert r["q"] == pytest.approx(list(np.quantile(data[r["k"]], fractions)))


@pytest.mark.parametrize("n, k", [(10, 3), (7, 7), (23, 5), (100, 1)])
def test_filled_buckets(spark, n, k):
    ends = bucket_ends(n, k)
    got = [r[0] for r in spark.range(n + 1).orderBy("id").select(filled_buckets(F.col("id"), F.lit(n), F.lit(k))).collect()]
    assert got == [sum(e < m for e in ends) for m in range(n + 1)]


def test_ranks_of_many_cut_offs(spark):
    """So many ranks that their intervals cover the table: counted in buckets, with the same values."""
    rng = random.Random(8)
    data = sorted(rng.randrange(4000) / 4 for _ in range(20_000))
    rows = literal(spark, [("v", v) for v in data], "k string, v double")
    ranks = list(range(0, 20_000, 50))
    found = rank_search(rows, {"v": ranks}, {"v": 20_000}, small=500, accuracy=100)["v"]
    assert [found[r].value for r in ranks] == [data[r] for r in ranks]


def test_many_labels(spark):
    rows = spark.range(13_000).select("id", (F.col("id") % 1300).alias("label"), (F.col("id") * 17 % 101).cast("double").alias("x"))
    many = {(r["label"], r["fold"]): r["n"] for r in sampling.stratified_folds(rows, "id", "label", 3).groupBy("label", "fold").agg(
        F.count("*").alias("n")).collect()}
    assert len(many) == 3900 and set(many.values()) == {3, 4}
    few = rows.where("label < 5")
    alone = {r["id"]: r["fold"] for r in sampling.stratified_folds(few, "id", "label", 3).collect()}
    assert alone == {r["id"]: r["fold"] for r in sampling.stratified_folds(rows, "id", "label", 3).where("label < 5").collect()}
    boxes = {r["label"]: r for r in profile.box_summary(rows, ["x"], "label").where("label < 5").collect()}
    for r in profile.box_summary(few, ["x"], "label").collect():
        assert boxes[r["label"]] == r


def test_hash_ranks_in_tiny_buckets(spark):
    rows = spark.range(3000)
    want = {r["id"]: r["rank"] for r in hash_ranked(rows, "id", 5).collect()}
    assert want == {r["id"]: r["rank"] for r in hash_ranked(rows, "id", 5, bucket_rows=2).collect()}
    assert sorted(want.values()) == list(range(1, 3001))


def test_streaks_of_more_than_512_chunks(spark):
    rng = random.Random(6)
    hits = [rng.random() < 0.9 for _ in range(3000)]
    rows = literal(spark, [(1, i, h) for i, h in enumerate(hits)], "who int, at bigint, hit boolean")
    found = streaks.streaks(rows, "who", "at", F.col("hit"), chunk_rows=4).first()
    runs = [len(r) for r in "".join("x" if h else " " for h in hits).split(" ")]
    assert (found["longest"], found["current"]) == (max(runs), runs[-1])


def test_batches(spark):
    rows = literal(spark, [(k,) for k in ["c", "a", "b", "b", "b", "d", None]], "k string")
    for amount, want in ((1, "a"), (2, "ab"), (3, "abb"), (5, "abbbc"), (99, "abbbcd")):
        assert "".join(sorted(r["k"] for r in enrich.next_batch(rows, "k", amount).collect())) == want


def test_places_keep_their_pairs_in_batch_and_stream(spark, tmp_path):
    rows = literal(spark, [(1, "x"), (2, "y"), (3, None)], "id bigint, home string")
    places = literal(spark, [("x", 20.0, 50.0), ("x", 10.0, 100.0), ("y", 5.0, 6.0), ("y", 5.0, 4.0)], "address string, lat double, lon double")
    want = {(1, 10.0, 100.0), (2, 5.0, 4.0), (3, None, None)}
    names = ["id", "home_lat", "home_lon"]
    assert {tuple(r) for r in enrich.resolve(rows, "id", ["home"], places).select(names).collect()} == want
    rows.write.parquet(f"{tmp_path}/in")
    query = enrich_stream(spark, f"{tmp_path}/in", rows.schema, "home", places, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(names).collect()} == want


def test_adaboost_needs_several_trees(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(7)
    points = [(rng.random(), rng.random()) for _ in range(400)]
    rows = literal(spark, [(a, b, int(a + b > 1)) for a, b in points], "a double, b double, label int")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)

    def right(n):
        out = AdaBoost(maxIter=n).fit(data).transform(data)
        return out.where("prediction = label").count() / 400

    assert right(12) > max(0.85, right(1))


def test_trees_of_any_depth(spark):
    """Each split takes the lowest value off, so the tree is as deep as it has values."""
    rows = spark.range(4 * 75).select((F.col("id") % 75).cast("double").alias("x"), (F.col("id") % 75 % 2).cast("int").alias("y"))
    nodes = tree.grow_tree(rows, ["x"], "y", "woe", allow_pure=True).orderBy("node_id").collect()
    assert [r["node_id"] for r in nodes] == list(range(1, 150)) and max(r["depth"] for r in nodes) == 75
    assert [r["bp"] for r in nodes if not r["is_leaf"]] == list(range(74))
    parents = {r["node_id"]: r for r in nodes}
    for r in nodes[1:]:
        up = parents[r["parent_id"]]
        assert r["depth"] == up["depth"] + 1 and up["bp"] in (r["lo"], r["hi"])


def test_trees_with_many_nodes_by_table(spark, monkeypatch):
    """Levels too large for literal rows give the same tree."""
    rng = random.Random(12)
    rows = literal(spark, [(float(rng.randrange(80)), float(rng.randrange(9)), rng.randrange(2)) for _ in range(500)], "a double, b double, y int")
    few = sorted(tree.grow_tree(rows, ["a", "b"], "y", "gini", max_depth=3).collect())
    monkeypatch.setattr(tree, "FEW_NODES", 1)
    assert sorted(tree.grow_tree(rows, ["a", "b"], "y", "gini", max_depth=3, bucket_rows=20).collect()) == few


@pytest.mark.parametrize("block_rows", [7, 40, 10_000])
def test_neighbours_among_copies_and_clusters(spark, block_rows):
    """A third of the rows is one vector, others lie in clusters or far away; keys are texts."""
    rng = random.Random(15)
    points = [(0.0, 0.0)] * 100 + [(c * 10.0 + rng.randrange(4), float(rng.randrange(4))) for c in range(4) for _ in range(45)]
    points += [(1000.0 * (i + 1), -5.0) for i in range(6)]
    names = [f"k{i:03d}" for i in rng.sample(range(len(points)), len(points))]
    rows = literal(spark, [(n, list(p)) for n, p in zip(names, points)], "name string, at array<double>")
    got = {}
    for r in resample.nearest_neighbours(rows, "name", "at", 6, block_rows).collect():
        got.setdefault(r["key"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    for name, (x, y) in zip(names, points):
        near = sorted((np.hypot(x - a, y - b), other) for other, (a, b) in zip(names, points) if other != name)[:6]
        assert [got[name][i + 1][0] for i in range(6)] == [other for _, other in near]
        assert [got[name][i + 1][1] for i in range(6)] == pytest.approx([d for d, _ in near])


def test_neighbours_of_equal_vectors(spark):
    rows = spark.range(9).select("id", F.array(F.lit(1.0)).alias("x"))
    got = {(r["key"], r["rank"]): r["neighbour"] for r in resample.nearest_neighbours(rows, "id", "x", 2).collect()}
    assert len(got) == 18 and got[0, 1] == 1 and got[0, 2] == 2 and got[1, 2] == 2 and got[8, 1] == 0 and got[8, 2] == 1


def test_neighbours_are_sent_once_a_group(spark, monkeypatch):
    """Vectors without structure visit nearly all of 60 cells, but travel to each of a few groups once."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1_500, 6)) * 10.0 ** rng.integers(-3, 1)
    rows = literal(spark, [(k, [float(v) for v in p]) for k, p in enumerate(points)], "id bigint, x array<double>")
    kept = {}
    monkeypatch.setattr(resample, "materialise", lambda df, stem="stage": kept.setdefault(stem, materialise(df, stem)))
    got = {(r["key"], r["rank"]): r["neighbour"] for r in resample.nearest_neighbours(rows, "id", "x", 3, 25).collect()}
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1)[:, :3]
    assert got == {(i, r + 1): int(near[i, r]) for i in range(1_500) for r in range(3)}
    sent = kept["reach"].agg(F.sum(F.size("wants")).alias("n"), F.count("*").alias("rows")).first()
    assert sent["rows"] == 1_500 and sent["n"] <= resample.GROUPS * 1_500
