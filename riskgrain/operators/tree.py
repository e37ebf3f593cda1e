"""Supervised tree binning, grown level by level for all features and nodes at once.

Rows are collapsed once to one per (feature, distinct value) with class counts
and running totals.  A node is a range of values, so the counts left of any
candidate are its running total minus the total at the node's lower end: each
level is one aggregation over the collapsed table, without sorting again.
Nodes are numbered breadth first within their feature, so a tree may have any
depth.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import entropy2, evidence, flag, gini2, number
from ..plans.prefix import running_totals
from ..session import literal, materialise
from .edges import INF, Edges

METRICS = ("woe", "iv", "entropy", "gini")
SMALLEST_NODE = 4
REWRITE_EVERY = 4  # levels between rewrites of the collapsed table
FEW_NODES = 20_000
SCORE_DIGITS = 12

NODE_COLUMNS = [
    "feature", "node_id", "parent_id", "depth", "lo", "hi", "size", "positive", "negative", "value", "bp", "is_leaf",
]


def value_counts(df: DataFrame, features: Sequence[str], label: str, pos=1, neg=0, **options) -> DataFrame:
    """Class counts and running totals per (feature, distinct value); nulls dropped."""
    known = F.col(label).isNotNull()
    rows = df.select(
        flag(label, pos).alias("_p"), F.when(known, flag(label, neg)).otherwise(0).alias("_n"),
        *[number(f).alias(f) for f in features],
    )
    long = rows.unpivot(["_p", "_n"], list(features), "feature", "v")
    sums = {"p": F.sum("_p"), "n": F.sum("_n"), "c": F.count("*")}
    return running_totals(long, "v", sums, ["feature"], **options)


def _score(metric: str, allow_pure: bool) -> tuple[Column, Column, Column, Column]:
    """Score to maximise, the two child values, and whether the split is allowed."""
    lp, ln_, lc = F.col("lp"), F.col("ln"), F.col("lc")
    rp, rn, rc = F.col("rp"), F.col("rn"), F.col("rc")
    size = lc + rc
    mixed = (lp > 0) & (ln_ > 0) & (rp > 0) & (rn > 0)
    if metric in ("woe", "iv"):
        lw, li = evidence(lp, ln_, F.col("tot_pos"), F.col("tot_neg"))
        rw, ri = evidence(rp, rn, F.col("tot_pos"), F.col("tot_neg"))
        allowed = F.lit(True) if allow_pure else mixed
        open_split = F.when(~mixed, F.lit(INF))
        if metric == "woe":
            return open_split.otherwise(F.abs(lw - rw)), lw, rw, allowed
        return open_split.otherwise(li + ri), li, ri, allowed
    if metric == "gini":
        lg, rg = gini2(lp, ln_), gini2(rp, rn)
        return -(lg * lc / size + rg * rc / size) / 2, lg, rg, mixed
    if metric == "entropy":
        le, re = entropy2(lp, ln_), entropy2(rp, rn)
        whole = entropy2(lp + rp, ln_ + rn)
        return whole - le * lc / size - re * rc / size, le, re, mixed
    raise ValueError(f"metric must be one of {METRICS}")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast where the number of rows is bounded; else leave it to the optimiser."""
    return F.broadcast(df) if rows <= FEW_NODES else df


def _best_splits(hist: DataFrame, nodes: DataFrame, n_nodes: int, metric: str, allow_pure: bool) -> DataFrame:
    """The best allowed split of every node; ties go to the smallest value.

    The best score is found first, on plain numbers, which aggregates by hash;
    only the rows that reach it carry the split's details.
    """
    sides = hist.join(_few(nodes, n_nodes), ["feature", "node_id"]).select(
        "feature", "node_id", "v", "tot_pos", "tot_neg", "least",
        (F.col("cum_p") - F.col("base_p")).alias("lp"),
        (F.col("cum_n") - F.col("base_n")).alias("ln"),
        (F.col("cum_c") - F.col("base_c")).alias("lc"),
        (F.col("positive") + F.col("base_p") - F.col("cum_p")).alias("rp"),
        (F.col("negative") + F.col("base_n") - F.col("cum_n")).alias("rn"),
        (F.col("size") + F.col("base_c") - F.col("cum_c")).alias("rc"),
    )
    score, left, right, allowed = _score(metric, allow_pure)
    candidates = sides.where((F.col("lc") >= F.col("least")) & (F.col("rc") >= F.col("least"))).where(allowed)
    # the one-element generator keeps the score from being recomputed in every filter on it
    candidates = candidates.select("*", F.explode(F.array(F.round(score, SCORE_DIGITS))).alias("score"))
    best = candidates.groupBy("feature", "node_id").agg(F.max("score").alias("top"))
    reached = candidates.join(_few(best, n_nodes), ["feature", "node_id"]).where("score = top")
    payload = F.struct(F.col("v").alias("bp"), "score", "lp", "ln", "lc", "rp", "rn", "rc", left.alias("lv"), right.alias("rv"))
    first = F.min_by(payload, "v").alias("s")
    return reached.groupBy("feature", "node_id").agg(first).select("feature", "node_id", "s.*")


def split_feature(
    df: DataFrame, features: Sequence[str], label: str, metric: str = "woe", min_split_size: int = SMALLEST_NODE,
    pos=1, neg=0, allow_pure: bool = False, **options,
) -> DataFrame:
    """Best single split per feature: breakpoint, score and the value of both sides."""
    hist = value_counts(df, features, label, pos, neg, **options).withColumn("node_id", F.lit(1).cast("bigint"))
    roots = _roots(hist).withColumn("least", F.lit(min_split_size))
    best = _best_splits(hist, _able(roots, SMALLEST_NODE), len(list(features)), metric, allow_pure)
    sign = -1.0 if metric == "gini" else 1.0
    return best.select(
        "feature", "bp", (F.col("score") * F.lit(sign)).alias("score"),
        F.col("lv").alias("value_left"), F.col("rv").alias("value_right"),
        F.col("lc").alias("size_left"), F.col("rc").alias("size_right"),
    )


def _able(nodes: DataFrame, smallest) -> DataFrame:
    """Nodes large and mixed enough to be split."""
    return nodes.where((F.col("size") >= smallest) & (F.col("positive") > 0) & (F.col("negative") > 0))


def _roots(hist: DataFrame) -> DataFrame:
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return hist.groupBy("feature").agg(
        F.sum("p").alias("positive"), F.sum("n").alias("negative"), F.sum("c").alias("size"),
    ).select(
        "feature", one.alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(1).alias("depth"), F.lit(-INF).alias("lo"), F.lit(INF).alias("hi"),
        "size", "positive", "negative", F.lit(None).cast("double").alias("value"),
        none.alias("base_p"), none.alias("base_n"), none.alias("base_c"),
        F.col("positive").alias("tot_pos"), F.col("negative").alias("tot_neg"), one.alias("level_end"),
    )


def _numbered(level: DataFrame, n_nodes: int) -> DataFrame:
    """Add the number of each split's left child and the last number of the next level.

    ``level_end`` is the last number of this level in the feature; the right
    child follows the left one.
    """
    if n_nodes <= FEW_NODES:
        every = W.partitionBy("feature")
        upto = every.orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
        counted = level.withColumns({"_rank": F.count("bp").over(upto), "_splits": F.count("bp").over(every)})
    else:
        ranks = running_totals(level, "node_id", {"c": F.count("bp")}, ["feature"])
        splits = ranks.groupBy("feature").agg(F.max("cum_c").alias("_splits"))
        ranks = ranks.select("feature", "node_id", F.col("cum_c").alias("_rank"))
        counted = level.join(ranks, ["feature", "node_id"]).join(splits, "feature")
    return counted.withColumns({
        "left_id": F.col("level_end") + 2 * F.col("_rank") - 1, "next_end": F.col("level_end") + 2 * F.col("_splits"),
    }).drop("_rank", "_splits")


def _fixed(level: DataFrame, n_nodes: int) -> tuple[DataFrame, int]:
    """The level written down, and how many of its nodes split."""
    if n_nodes <= FEW_NODES:
        rows = level.collect()
        return literal(level.sparkSession, rows, level.schema), sum(r["bp"] is not None for r in rows)
    level = materialise(level, "tree-level")
    return level, level.where("bp is not null").count()


def _children(level: DataFrame) -> DataFrame:
    """Two child nodes per split node."""
    left = F.struct(
        F.col("left_id").alias("node_id"), F.col("lo").alias("lo"), F.col("bp").alias("hi"),
        F.col("lc").alias("size"), F.col("lp").alias("positive"), F.col("ln").alias("negative"), F.col("lv").alias("value"),
        F.col("base_p").alias("base_p"), F.col("base_n").alias("base_n"), F.col("base_c").alias("base_c"),
    )
    right = F.struct(
        (F.col("left_id") + 1).alias("node_id"), F.col("bp").alias("lo"), F.col("hi").alias("hi"),
        F.col("rc").alias("size"), F.col("rp").alias("positive"), F.col("rn").alias("negative"), F.col("rv").alias("value"),
        (F.col("base_p") + F.col("lp")).alias("base_p"), (F.col("base_n") + F.col("ln")).alias("base_n"),
        (F.col("base_c") + F.col("lc")).alias("base_c"),
    )
    return level.where("bp is not null").select(
        "feature", "tot_pos", "tot_neg", "leaf", "least", F.col("next_end").alias("level_end"),
        F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"),
        F.explode(F.array(left, right)).alias("c"),
    ).select(
        "feature", "c.node_id", "parent_id", "depth", "c.lo", "c.hi", "c.size", "c.positive", "c.negative", "c.value",
        "c.base_p", "c.base_n", "c.base_c", "tot_pos", "tot_neg", "level_end", "leaf", "least",
    )


def _smallest(size: float, total: int, name: str) -> int:
    if not 0 < size < total:
        raise ValueError(f"{name} must lie in (0, {total})")
    return max(SMALLEST_NODE, math.floor(total * size) if size < 1 else int(size))


def grow_tree(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    metric: str = "woe",
    max_depth: float = math.inf,
    min_leaf_size: float = SMALLEST_NODE,
    min_split_size: float = SMALLEST_NODE,
    pos=1,
    neg=0,
    allow_pure: bool = False,
    **options,
) -> DataFrame:
    """Grow one tree per feature; returns one row per node.

    Sizes below 1 are fractions of the feature's known rows.  The root has depth
    1 and a node splits while its depth is at most ``max_depth``.  WOE and IV use
    the root's totals.  Splits that leave one class on a side are skipped unless
    ``allow_pure``.  ``node_id`` counts a feature's nodes level by level, from
    low to high values; the root is 1.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    features = list(features)
    hist = materialise(value_counts(df, features, label, pos, neg, **options), "tree-values")
    hist = hist.withColumn("node_id", F.lit(1).cast("bigint"))
    roots = _roots(hist)
    found = roots.collect()  # one row per feature
    leaf = [_smallest(min_leaf_size, r["size"], "min_leaf_size") for r in found]
    least = [max(_smallest(min_split_size, r["size"], "min_split_size"), m) for r, m in zip(found, leaf)]
    frontier = literal(
        df.sparkSession, [(*r, *sizes) for r, *sizes in zip(found, leaf, least)],
        roots.withColumns({"leaf": F.lit(0).cast("bigint"), "least": F.lit(0).cast("bigint")}).schema,
    )

    levels = []
    n_nodes, depth = len(found), 1
    while n_nodes and depth <= max_depth:
        splits = _best_splits(hist, _able(frontier, F.col("leaf")), n_nodes, metric, allow_pure)
        level = frontier.join(_few(splits, n_nodes), ["feature", "node_id"], "left")
        level, n_splits = _fixed(_numbered(level, n_nodes), n_nodes)
        levels.append(level.withColumn("is_leaf", F.col("bp").isNull()).select(*NODE_COLUMNS))
        frontier = _children(level)
        # leaves' rows leave the table here, so each level works on less
        cut = level.where("bp is not null").select("feature", "node_id", "bp", "left_id")
        hist = hist.join(_few(cut, n_splits), ["feature", "node_id"]).withColumn(
            "node_id", F.col("left_id") + (F.col("v") > F.col("bp")).cast("bigint")
        ).drop("bp", "left_id")
        if depth % REWRITE_EVERY == 0 and n_splits:
            hist = materialise(hist, "tree-values")
        n_nodes = 2 * n_splits
        depth += 1
    if n_nodes or not levels:
        levels.append(frontier.withColumns({"bp": F.lit(None).cast("double"), "is_leaf": F.lit(True)}).select(*NODE_COLUMNS))
    result = levels[0]
    for part in levels[1:]:
        result = result.unionByName(part)
    return result


def tree_breakpoints(nodes: DataFrame) -> DataFrame:
    """Inner breakpoints of every feature in ascending order."""
    return nodes.where("bp is not null").groupBy("feature").agg(F.sort_array(F.collect_list("bp")).alias("breakpoints"))


def breakpoints_by_depth(nodes: DataFrame) -> DataFrame:
    """Breakpoints per feature and tree level; a level of leaves has none."""
    return nodes.groupBy("feature", "depth").agg(F.sort_array(F.collect_list("bp")).alias("breakpoints"))


def tree_edges(
    nodes: DataFrame, feature: str, span: tuple[float, float], left: float | None = None,
    right: float | None = None, edge: str | None = "range",
) -> Edges:
    """Breakpoints of one feature with outer edges; ``edge`` overrides ``left`` and ``right``."""
    inner = [r["bp"] for r in nodes.where((F.col("feature") == feature) & F.col("bp").isNotNull()).select("bp").collect()]
    pad = (span[1] - span[0]) * 0.005
    low, high = span[0] - pad, span[1] + pad
    if edge == "inf":
        low, high = -INF, INF
    elif edge is None:
        low = low if left is None else left
        high = high if right is None else right
    elif edge != "range":
        raise ValueError(f"unknown edge policy {edge!r}")
    return Edges((low, *sorted(inner), high))
