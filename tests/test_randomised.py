"""Random small tables against plain definitions, on every route the library can take."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrain.operators import binning, evaluate, resample, sampling, streaks, tree
from riskgrain.operators.keywords import keyword_iv, presence_matrix
from riskgrain.plans.hash_rank import hash_ranked
from riskgrain.plans.order_stats import cutoffs, long_rows, quantiles, rank_search
from riskgrain.plans.prefix import running_totals
from riskgrain.session import literal


def samples():
    rng = random.Random(5)
    yield "distinct", [rng.random() * 100 - 50 for _ in range(3000)]
    # a third of all rows share one value
    yield "hot", [7.0 if i % 3 == 0 else rng.gauss(0, 40) for i in range(3000)]
    yield "few", [float(rng.randrange(4)) for _ in range(2000)]
    yield "constant", [3.5] * 500


SAMPLES = dict(samples())
FRACTIONS = [0, 0.013, 0.25, 0.5, 0.77, 0.999, 1]


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("small, accuracy", [(10**6, 10_000), (50, 20), (200, 100)])
def test_quantiles(spark, name, small, accuracy):
    data = SAMPLES[name]
    df = literal(spark, [(v, 2 * v) for v in data], "a double, b double")
    got = quantiles(df, {"a": F.col("a"), "b": F.col("b")}, FRACTIONS, small=small, accuracy=accuracy)
    assert got["a"] == pytest.approx(list(np.quantile(data, FRACTIONS)), abs=1e-9)
    assert got["b"] == pytest.approx(list(np.quantile(np.array(data) * 2, FRACTIONS)), abs=1e-9)


@pytest.mark.parametrize("name", SAMPLES)
def test_ranks_are_exact(spark, name):
    data = sorted(SAMPLES[name])
    rows = long_rows(literal(spark, [(v,) for v in data], "a double"), {"a": F.col("a")})
    ranks = sorted(random.Random(1).sample(range(len(data)), 40))
    found = rank_search(rows, {"a": ranks}, {"a": len(data)}, small=30, accuracy=50)["a"]
    for r in ranks:
        at = found[r]
        assert at.value == data[r] and at.n_less == sum(v < data[r] for v in data) and at.n_equal == data.count(data[r])


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("n", [1, 7, 40])
def test_even_buckets_equal_ntile(spark, name, n):
    data = SAMPLES[name]
    df = literal(spark, [(i * 37 % 100_003, v) for i, v in enumerate(data)], "id bigint, v double")
    got = {r["id"]: r["bucket"] for r in binning.even_buckets(df, "v", "id", n, small=100).collect()}
    order = sorted((v, i * 37 % 100_003) for i, v in enumerate(data))
    size, longer = divmod(len(order), n)
    want = {}
    for rank, (_, key) in enumerate(order):
        want[key] = rank // (size + 1) + 1 if rank < longer * (size + 1) else longer + (rank - longer * (size + 1)) // size + 1
    assert got == want


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("bucket_rows", [10**6, 40])
def test_running_totals(spark, name, bucket_rows):
    data = SAMPLES[name]
    df = literal(spark, [("g" if i % 5 else "h", v) for i, v in enumerate(data)], "g string, v double")
    rows = running_totals(df, "v", {"n": F.count("*")}, ["g"], bucket_rows=bucket_rows).collect()
    for g in "gh":
        mine = sorted(v for i, v in enumerate(data) if ("g" if i % 5 else "h") == g)
        got = {r["v"]: (r["n"], r["cum_n"]) for r in rows if r["g"] == g}
        assert got == {v: (mine.count(v), sum(x <= v for x in mine)) for v in set(mine)}


def test_hash_ranks_partition_the_rows(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    rows = hash_ranked(df, "id", 4, by=["g"]).collect()
    for g in range(3):
        mine = sorted(r["rank"] for r in rows if r["g"] == g)
        assert mine == list(range(1, len(mine) + 1))


def plain_auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    return sum(pairs) / len(pairs)


def plain_ks(y, s, n_bin):
    order = sorted(s)
    n_bin = min(n_bin, len(s))
    size, longer = divmod(len(s), n_bin)
    ends, last = [], -1
    for i in range(n_bin):
        last += size + (i < longer)
        ends.append(order[last])
    pos, neg = sum(y), len(y) - sum(y)
    return abs(max(sum(p and v >= t for p, v in zip(y, s)) / pos - sum((not p) and v >= t for p, v in zip(y, s)) / neg for t in ends))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("bucket_rows", [10**6, 10])
def test_auc_and_ks(spark, seed, bucket_rows):
    rng = random.Random(seed)
    n = rng.choice([15, 60, 300])
    s = [float(rng.randrange(rng.choice([3, 1000]))) for _ in range(n)]
    y = [int(rng.random() < 0.3 + 0.4 * (v > 1)) for v in s]
    y[:2] = [0, 1]
    df = literal(spark, list(zip(y, s)), "y int, s double")
    assert evaluate.auc(df, "y", "s", bucket_rows=bucket_rows).first()[0] == pytest.approx(plain_auc(y, s))
    for n_bin in (7, 50):
        assert evaluate.ks(df, "y", "s", n_bin).first()[0] == pytest.approx(plain_ks(y, s, n_bin))
        both = evaluate.evaluation(df, "y", "s", n_bin=n_bin, bucket_rows=bucket_rows).first()
        assert both["ks"] == pytest.approx(plain_ks(y, s, n_bin)) and both["auc"] == pytest.approx(plain_auc(y, s))


def gini(p, n):
    return 0 if p + n == 0 else 2 * p * n / (p + n) ** 2


def entropy(p, n):
    return -sum(k / (p + n) * math.log(k / (p + n)) for k in (p, n) if k)


def plain_tree(rows, metric, max_depth, min_leaf, min_split, totals, depth=1):
    """Breakpoints by growing depth first."""
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if depth > max_depth or len(rows) < max(min_leaf, 4) or not p or not n:
        return []
    best = None
    for v in sorted({x for x, _ in rows})[:-1]:
        left, right = [r for r in rows if r[0] <= v], [r for r in rows if r[0] > v]
        if min(len(left), len(right)) < min_split:
            continue
        (lp, ln), (rp, rn) = [(sum(y for _, y in side), sum(1 - y for _, y in side)) for side in (left, right)]
        if not (lp and ln and rp and rn):
            continue
        w = [(len(left)) / len(rows), len(right) / len(rows)]
        lw, rw = [math.log((a / totals[0]) / (b / totals[1])) for a, b in ((lp, ln), (rp, rn))]
        score = {
            "woe": abs(lw - rw),
            "iv": (lp / totals[0] - ln / totals[1]) * lw + (rp / totals[0] - rn / totals[1]) * rw,
            "gini": -(w[0] * gini(lp, ln) + w[1] * gini(rp, rn)) / 2,
            "entropy": entropy(p, n) - w[0] * entropy(lp, ln) - w[1] * entropy(rp, rn),
        }[metric]
        if best is None or round(score, 12) > best[0]:
            best = (round(score, 12), v, left, right)
    if best is None:
        return []
    _, v, left, right = best
    rest = (metric, max_depth, min_leaf, min_split, totals, depth + 1)
    return plain_tree(left, *rest) + [v] + plain_tree(right, *rest)


@pytest.mark.parametrize("metric, depth, split, bucket_rows", [
    ("woe", 3, 8, 10**6), ("iv", math.inf, 12, 6), ("gini", 2, 4, 10**6), ("entropy", math.inf, 20, 9),
])
def test_tree(spark, metric, depth, split, bucket_rows):
    rng = random.Random(split)
    rows = [(float(rng.randrange(25)), int(rng.random() < 0.4)) for _ in range(160)]
    other = [float(rng.randrange(60)) for _ in rows]
    df = literal(spark, [(x, o, y) for (x, y), o in zip(rows, other)], "a double, b double, y int")
    nodes = tree.grow_tree(df, ["a", "b"], "y", metric, max_depth=depth, min_leaf_size=split, min_split_size=split, bucket_rows=bucket_rows)
    got = {r["feature"]: r["breakpoints"] for r in tree.tree_breakpoints(nodes).collect()}
    totals = (sum(y for _, y in rows), sum(1 - y for _, y in rows))
    for f, xs in (("a", [x for x, _ in rows]), ("b", other)):
        assert got[f] == plain_tree([(x, y) for x, (_, y) in zip(xs, rows)], metric, depth, split, split, totals)
    leaves = nodes.where("is_leaf").groupBy("feature").agg(F.sum("size").alias("n")).collect()
    assert [r["n"] for r in leaves] == [160, 160]


@pytest.mark.parametrize("chunk_rows", [10, 57, 10**6])
def test_streaks_with_a_hot_entity(spark, chunk_rows):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"e{rng.randrange(12)}", i, rng.random() < 0.7) for i in range(900)]
    df = literal(spark, rows, "e string, t int, h boolean")
    got = {r["e"]: (r["current"], r["longest"]) for r in streaks.streaks(df, "e", "t", F.col("h"), chunk_rows).collect()}
    for e in {r[0] for r in rows}:
        hits = [h for k, _, h in rows if k == e]
        longest = max((len(list(g)) for k, g in itertools.groupby(hits) if k), default=0)
        current = len(list(itertools.takewhile(bool, reversed(hits))))
        assert got[e] == (current, longest)


@pytest.mark.parametrize("block_rows, cells", [(4096, 256), (16, 8), (7, 3)])
def test_nearest_neighbours(spark, block_rows, cells):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 5, 9)])
    points[:40] = points[0]  # a third of the points are copies of one
    df = literal(spark, [(i, [float(v) for v in p]) for i, p in enumerate(points)], "id bigint, x array<double>")
    got = {(r["key"], r["rank"]): r["neighbour"] for r in resample.nearest_neighbours(df, "id", "x", 4, block_rows, cells).collect()}
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        order = sorted((dist, j) for j, dist in enumerate(d) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in order]


def test_synthetic_points_lie_on_segments(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=2)], int(i < 12)) for i in range(60)]
    df = literal(spark, rows, "id bigint, x array<double>, y int")
    made = resample.synthetic_minority(df, "id", "x", "y", ratio=1.0, k=3).collect()
    assert len(made) == 36
    at = {i: np.array(x) for i, x, _ in rows}
    for r in made:
        assert np.allclose(r["x"], at[r["base"]] + r["step"] * (at[r["neighbour"]] - at[r["base"]]))
        assert rows[r["base"]][2] == 1 and rows[r["neighbour"]][2] == 1 and 0 <= r["step"] < 1


def test_splits_are_disjoint_and_sized(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 < 3).cast("int"))
    rows = sampling.stratified_split(df, "id", "y", {"test": 100, "train": 200, "val": 50}).collect()
    count = {(s, y): sum(1 for r in rows if r["split"] == s and r["y"] == y) for s in ("test", "train", "val") for y in (0, 1)}
    assert count == {("test", 0): 70, ("test", 1): 30, ("train", 0): 140, ("train", 1): 60, ("val", 0): 35, ("val", 1): 15}
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "id", "y", {"test": 900, "train": 200})


def test_folds_partition_each_label(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    rows = sampling.stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    other = sampling.stratified_folds(df, "id", "y", 5, seed=8).collect()
    assert [r["fold"] for r in other] != [r["fold"] for r in sampling.stratified_folds(df, "id", "y", 5).collect()]


def test_nested_split_never_leaks(spark):
    rows = sampling.nested_split(spark.range(200), "id", 0.25, 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"test": 50, "val": 30, "train": 120}


def test_cutoffs_split_ties_by_key(spark):
    rows = literal(spark, [("a", 1.0, i) for i in range(100)] + [("a", 2.0, i) for i in range(50)], "k string, v double, tie bigint")
    got = cutoffs(rows, {"a": [9, 99, 120]}, {"a": 150})["a"]
    assert got == [(1.0, 9), (1.0, None), (2.0, 20)]


def test_keyword_iv_routes_agree(spark):
    rng = random.Random(9)
    words = ["ab", "cd", "e", "never"]
    docs = [(i, " ".join(rng.choice(["ab", "cd", "ee", "x"]) for _ in range(4)), rng.choice([True, False, None])) for i in range(80)]
    df = literal(spark, docs, "id bigint, text string, y boolean")
    wide = presence_matrix(df, "id", "text", words, prefix="k_").join(df.select("id", "y"), "id")
    a = [tuple(r) for r in keyword_iv(df, words, "y", text="text").collect()]
    b = [tuple(r) for r in keyword_iv(wide, words, "y", prefix="k_").collect()]
    known = [(t, y) for _, t, y in docs if y is not None]
    tp, tn = sum(y for _, y in known), sum(not y for _, y in known)
    for (pos, word, iv), other in zip(a, b):
        want = 0.0
        for has in (True, False):
            group = [y for t, y in known if (word in t) == has]
            if group:
                p, n = (sum(group) + 1) / (tp + 2), (len(group) - sum(group) + 1) / (tn + 2)
                want += (p - n) * math.log(p / n)
        assert word == words[pos] and iv == pytest.approx(want) and other[2] == pytest.approx(want)
