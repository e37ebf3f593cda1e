"""Second-order boosted trees: every split from sums of gradients and hessians.

Features are cut once into at most ``maxBins`` bins of equal hessian.  A level of a tree is one aggregation
of (gradient, hessian, rows) by node, feature and bin; only the child with fewer rows is aggregated, its
sibling is the parent less it.  Gains come from running sums over the bins, and only each node's best split reaches the
driver.  Leaves weigh ``-step * G / (H + regLambda)``.

Several models grow in the same jobs: model ``m`` trains on the rows whose fold is not ``m``, so a
cross-validation costs the scans of one fit.  Rows keep their margins; the table is rewritten every few rounds, so plans
stay short and lost executors cost a re-read.

What reaches the driver is bounded by parameters: edges (features x bins) and nodes (models x 2 ** depth).
Missing values (null, NaN) lie below all others, in a bin of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import literal, materialise

#: Rounds between two rewrites of the margins.
REWRITE = 4
#: Gains and least hessians are compared at this many decimals, so that the order of summation does not decide; equal ones go to the first feature and bin.
DIGITS = 9
FINER = 4
TREE = "struct<f:array<int>,t:array<double>,v:array<double>>"


@dataclass
class Tree:
    """Nodes by heap position, the root at 0: feature (-1: leaf), threshold, bin, leaf value; splits as (feature, gain, cover)."""

    depth: int
    feature: list[int] = field(init=False)
    threshold: list[float] = field(init=False)
    bin: list[int] = field(init=False)
    value: list[float] = field(init=False)
    splits: list[tuple[int, float, float]] = field(init=False)

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.threshold, self.bin, self.value, self.splits = [-1] * size, [0.0] * size, [0] * size, [0.0] * size, []

    def plain(self, binned: bool) -> dict:
        return {"f": self.feature, "t": [float(b) for b in self.bin] if binned else self.threshold, "v": self.value}


def _position(values: Column, tree: Column, depth: int) -> Column:
    """Heap position (from 1) at which a row ends in a tree."""
    def step(at: Column, _: Column) -> Column:
        feature = F.get(tree["f"], at - 1)
        value = F.get(values, feature)
        above = F.coalesce((value > F.get(tree["t"], at - 1)) & ~F.isnan(value), F.lit(False))
        return F.when(feature < 0, at).otherwise(2 * at + above.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def _sum_of_trees(values: Column, trees: Column, depth: int, start: Column) -> Column:
    return F.aggregate(trees, start, lambda total, tree: total + F.get(tree["v"], _position(values, tree, depth) - 1))


def _fixed(value, kind: str) -> Column:
    """A nested value as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _indices(edges: Sequence[np.ndarray]) -> Callable:
    def run(batches):
        for batch in batches:
            x = batch.column("x")
            values, offsets = x.values.to_numpy(zero_copy_only=False).astype(float), x.offsets.to_numpy()
            rows = values[offsets[0]:offsets[-1]].reshape(len(x), -1)
            cells = np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c)) for c, e in zip(rows.T, edges)], axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel().astype(np.int32)))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "x"}
            yield pa.record_batch({**columns, "bins": lists})
    return run


def _finest(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Of each feature minus infinity, below which only missing values lie, and up to ``FINER * bins`` values at equal distances of rank."""
    shares = [k / (FINER * bins) for k in range(FINER * bins + 1)]
    width = (rows.select(F.size("x").alias("n")).first() or [0])[0]
    found = rows.select(F.posexplode("x").alias("i", "v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("i").agg(
        F.array_distinct(F.percentile_approx("v", shares)).alias("q"))
    known = {r["i"]: np.array(r["q"], float) for r in found.collect()}
    return [np.concatenate([[-np.inf], known.get(i, np.zeros(1))]) for i in range(width)]


def _merged_cells(hessian: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each fine cell: bins of about equal hessian."""
    if len(hessian) <= bins:
        return np.arange(len(hessian))
    reached = np.cumsum(hessian) / max(hessian.sum(), 1e-300)
    number = np.minimum(np.floor(np.concatenate([[0], reached[:-1]]) * bins), bins - 1).astype(int)
    return np.unique(number, return_inverse=True)[1]


class Booster:
    """Grows ``models`` series of trees side by side on ``df``; ``fold`` names the model that a row does not train."""

    def __init__(
        self, df: DataFrame, label: str, features: str, models: int = 1, fold: str | None = None, weight: str | None = None, max_bins: int = 256,
        max_depth: int = 6, step: float = 0.3, reg_lambda: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0,
    ):
        self.models, self.depth, self.step, self.l2, self.gamma, self.least = models, max_depth, step, reg_lambda, gamma, min_child_weight
        vector = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(F.col(features))
        rows = df.select(
            F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
            (F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)).alias("fold"), vector.alias("x"))
        rows = materialise(rows, "boost-rows")
        kind = "y double, weight double, fold int, bins array<int>"
        fine = _finest(rows, max_bins)
        cells = materialise(rows.mapInArrow(_indices([f[:-1] for f in fine]), kind), "boost-cells")
        # all margins are 0, so the hessians are a quarter of the weights
        sums = cells.select("weight", F.posexplode("bins").alias("i", "c")).groupBy("i", "c").agg(F.sum("weight").alias("h"))
        hessian = [np.zeros(len(f)) for f in fine]
        for i, c, h in sums.collect():
            hessian[i][c] = h / 4
        # missing values keep a bin of their own
        merged = [np.concatenate([[0], 1 + _merged_cells(h[1:], max_bins)]) for h in hessian]
        self.edges = [f[:-1][np.diff(m) > 0] for f, m in zip(fine, merged)]
        table = _fixed([m.tolist() for m in merged], "array<array<int>>")
        self.rows = materialise(cells.select(
            "y", "weight", "fold", F.transform("bins", lambda c, i: F.get(F.get(table, i), c)).alias("bins"),
            F.array_repeat(F.lit(0.0), models).alias("margins")), "boost-rows")
        self.trees: list[list[Tree]] = [[] for _ in range(models)]
        self.settled = 0

    def _scored(self, rounds: slice, binned: bool = True) -> Column:
        return _fixed([[t.plain(binned) for t in trees[rounds]] for trees in self.trees], f"array<array<{TREE}>>")

    def _margin(self, m: Column) -> Column:
        fresh = self._scored(slice(self.settled, None))
        return _sum_of_trees(F.col("bins"), F.get(fresh, m), self.depth, F.get("margins", m))

    def _histogram(self, growing: list[Tree], nodes: list[list[int]]) -> DataFrame:
        """``(m, node, i, b, g, h, n)`` of the given nodes of each model's growing tree."""
        partial = _fixed([t.plain(True) for t in growing], f"array<{TREE}>")
        asked = _fixed(nodes, "array<array<int>>")
        each = F.transform(F.sequence(F.lit(0), F.lit(self.models - 1)), lambda m: F.struct(
            m.alias("m"), _position(F.col("bins"), F.get(partial, m), self.depth).alias("node"), self._margin(m).alias("margin")))
        rows = self.rows.select("y", "weight", "fold", "bins", F.explode(each).alias("s")).where(
            (F.col("fold") != F.col("s.m")) & F.array_contains(F.get(asked, F.col("s.m")), F.col("s.node")))
        p = 1 / (1 + F.exp(-F.col("s.margin")))
        parts = rows.select(
            "s.m", "s.node", (F.col("weight") * (p - F.col("y"))).alias("g"), (F.col("weight") * p * (1 - p)).alias("h"),
            F.posexplode("bins").alias("i", "b"))
        return parts.groupBy("m", "node", "i", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))

    def _siblings(self, above: DataFrame, small: DataFrame, kin: list[tuple[int, int, int, int]]) -> DataFrame:
        """The other children: their parents' sums less those of the smaller ones."""
        names = literal(self.rows.sparkSession, kin, "m int, node int, less int, rest int")
        less = small.select("m", F.col("node").alias("less"), "i", "b", F.col("g").alias("g1"), F.col("h").alias("h1"), F.col("n").alias("n1"))
        left = above.join(F.broadcast(names), ["m", "node"]).join(less, ["m", "less", "i", "b"], "left")
        zero = F.lit(0.0)
        return left.select(
            "m", F.col("rest").alias("node"), "i", "b", (F.col("g") - F.coalesce("g1", zero)).alias("g"),
            (F.col("h") - F.coalesce("h1", zero)).alias("h"), (F.col("n") - F.coalesce("n1", F.lit(0))).alias("n")).where("n > 0")

    def _best_splits(self, hist: DataFrame) -> list:
        group = W.partitionBy("m", "node", "i")
        upto = group.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        summed = hist.select("m", "node", "i", "b", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(group).alias(c) for c in "ghn"])
        gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")

        def worth(g: Column, h: Column) -> Column:
            return g * g / (h + self.l2)

        fits = (F.col("nl") < F.col("n")) & (F.round("hl", DIGITS) >= self.least) & (F.round(hr, DIGITS) >= self.least)
        gain = F.when(fits, worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("g"), F.col("h"))).otherwise(-1.0)
        rated = summed.withColumn("gain", F.round(gain, DIGITS))
        return rated.groupBy("m", "node").agg(F.max_by(
            F.struct("i", "b", "gl", "hl", "nl", "g", "h", "n", "gain"), F.struct("gain", -F.col("i"), -F.col("b"))).alias("s")).select("m", "node", "s.*").collect()

    def _leaf(self, g: float, h: float) -> float:
        return -self.step * g / (h + self.l2)

    def _round(self) -> None:
        growing = [Tree(self.depth) for _ in range(self.models)]
        small, kin, above = [[1] for _ in growing], [], None
        for level in range(self.depth):
            hist = self._histogram(growing, small)
            if kin:
                part = materialise(hist, "boost-part")
                hist = part.unionByName(self._siblings(above, part, kin))
            if level + 1 < self.depth:
                hist = materialise(hist, "boost-level")
            found = self._best_splits(hist)
            small, kin, above = [[] for _ in growing], [], hist
            for s in found:
                tree, at = growing[s["m"]], s["node"] - 1
                if level == 0:
                    tree.value[at] = self._leaf(s["g"], s["h"])
                if s["gain"] <= max(self.gamma, 0.0):
                    continue
                tree.feature[at], tree.bin[at], tree.threshold[at] = s["i"], s["b"], float(self.edges[s["i"]][s["b"]])
                tree.splits.append((s["i"], s["gain"], s["h"]))
                tree.value[2 * at + 1] = self._leaf(s["gl"], s["hl"])
                tree.value[2 * at + 2] = self._leaf(s["g"] - s["gl"], s["h"] - s["hl"])
                children = (2 * s["node"], 2 * s["node"] + 1)
                less, rest = children if 2 * s["nl"] <= s["n"] else children[::-1]
                small[s["m"]].append(less)
                kin.append((s["m"], s["node"], less, rest))
            if not kin:
                break
        for trees, tree in zip(self.trees, growing):
            trees.append(tree)

    def grow(self, rounds: int) -> None:
        for _ in range(rounds):
            if len(self.trees[0]) - self.settled >= REWRITE:
                margins = F.transform(F.sequence(F.lit(0), F.lit(self.models - 1)), self._margin)
                self.rows = materialise(self.rows.withColumn("margins", margins), "boost-rows")
                self.settled = len(self.trees[0])
            self._round()

    def curve(self, first: int, last: int) -> DataFrame:
        """``(m, test, rounds, y, score)`` of every row, model and round from ``first + 1`` to ``last``; of rounds since the last rewrite."""
        if first < self.settled:
            raise ValueError("rounds before the last rewrite are gone")
        before, shown = self._scored(slice(self.settled, first)), self._scored(slice(first, last))

        def scores(m: Column) -> Column:
            start = _sum_of_trees(F.col("bins"), F.get(before, m), self.depth, F.get("margins", m))
            sums = F.aggregate(F.get(shown, m), F.array(start), lambda acc, tree: F.array_append(
                acc, F.element_at(acc, -1) + F.get(tree["v"], _position(F.col("bins"), tree, self.depth) - 1)))
            return F.struct(m.alias("m"), F.slice(sums, 2, last - first).alias("s"))

        each = F.transform(F.sequence(F.lit(0), F.lit(self.models - 1)), scores)
        rows = self.rows.select("y", "fold", F.explode(each).alias("c"))
        return rows.select("y", (F.col("fold") == F.col("c.m")).alias("test"), "c.m", F.posexplode("c.s").alias("k", "score")).select(
            "m", "test", (F.col("k") + 1 + first).alias("rounds"), "y", "score")


class _TreeParams(HasLabelCol, HasFeaturesCol, HasWeightCol, HasMaxIter, HasStepSize):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "added to a leaf's hessian", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a child", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "unused: nothing is drawn", TypeConverters.toInt)

    DEFAULTS = {"maxIter": 20, "maxDepth": 6, "stepSize": 0.3, "maxBins": 256, "regLambda": 1.0, "gamma": 0.0, "minChildWeight": 1.0}

    def booster_options(self) -> dict:
        return {
            "max_bins": self.getOrDefault(self.maxBins), "max_depth": self.getOrDefault(self.maxDepth), "step": self.getStepSize(),
            "reg_lambda": self.getOrDefault(self.regLambda), "gamma": self.getOrDefault(self.gamma),
            "min_child_weight": self.getOrDefault(self.minChildWeight)}


class BoostedTreesModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probability, margin and class of each row; ``splits`` are (round, feature, gain, cover)."""

    trees = Param(Params._dummy(), "trees", "nodes of each round as JSON", TypeConverters.toString)
    splits = Param(Params._dummy(), "splits", "(round, feature, gain, cover) of each split as JSON", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", trees: str = "[]", splits: str = "[]", maxDepth: int = 1):
        super().__init__()
        self._set(**self._input_kwargs)

    def split_table(self) -> list[tuple[int, int, float, float]]:
        return [tuple(s) for s in json.loads(self.getOrDefault(self.splits))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = vector_to_array(F.col(self.getFeaturesCol()))
        trees = F.from_json(F.lit(self.getOrDefault(self.trees)), f"array<{TREE}>")
        total = _sum_of_trees(values, trees, self.getOrDefault(self.maxDepth), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return dataset.withColumn("_margin", total).select(
            *dataset.columns, array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))).alias("rawPrediction"),
            array_to_vector(F.array(1 - p, p)).alias("probability"), (F.col("_margin") > 0).cast("double").alias("prediction"))


class BoostedTrees(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Two classes, 0 and 1, by the logistic loss; the first margin is 0."""

    @keyword_only
    def __init__(
        self, *, labelCol: str = "label", featuresCol: str = "features", weightCol: str | None = None, maxIter: int = 20, maxDepth: int = 6,
        stepSize: float = 0.3, maxBins: int = 256, regLambda: float = 1.0, gamma: float = 0.0, minChildWeight: float = 1.0, seed: int = 0,
    ):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        weight = self.getWeightCol() if self.isSet(self.weightCol) else None
        booster = Booster(dataset, self.getLabelCol(), self.getFeaturesCol(), weight=weight, **self.booster_options())
        booster.grow(self.getMaxIter())
        trees = booster.trees[0]
        return BoostedTreesModel(
            featuresCol=self.getFeaturesCol(), maxDepth=self.getOrDefault(self.maxDepth),
            trees=json.dumps([t.plain(False) for t in trees]),
            splits=json.dumps([(r, *s) for r, t in enumerate(trees) for s in t.splits]))
