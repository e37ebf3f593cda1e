"""Breakpoints of numeric variables.

Breakpoints are a handful of numbers, so they live on the driver; finding them
is the distributed part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import number
from ..plans.order_stats import TREE_TESTS, quantiles, slot_of, with_slot
from ..session import literal

INF = float("inf")
TREE_METHODS = ("woe", "iv", "gini", "entropy")


@dataclass(frozen=True)
class Edges:
    """Strictly ascending breakpoints of right-closed bins.

    ``closed_low`` puts the lowest breakpoint itself into the first bin, which is
    what computed breakpoints need; explicit lists leave it out.
    """

    points: tuple[float, ...]
    closed_low: bool = False

    def __post_init__(self):
        if len(self.points) < 2:
            raise ValueError("at least two breakpoints are needed")
        if any(a >= b for a, b in zip(self.points, self.points[1:])):
            raise ValueError(f"breakpoints must strictly ascend: {list(self.points)}")

    @property
    def n_bins(self) -> int:
        return len(self.points) - 1

    def bin_of(self, c: str | Column) -> Column:
        """0-based bin of a value; -1 for null, NaN and out of range."""
        x = number(c)
        low, high = F.lit(self.points[0]), F.lit(self.points[-1])
        inside = (x >= low if self.closed_low else x > low) & (x <= high)
        which = slot_of(x, self.points[1:-1])
        return F.when(inside, which).otherwise(F.lit(-1)).cast("int")

    def assign(self, df: DataFrame, c: str | Column, out: str) -> DataFrame:
        """Add the bin of a value; the route for many bins."""
        if self.n_bins - 1 <= TREE_TESTS:
            return df.withColumn(out, self.bin_of(c))
        low, high = F.lit(self.points[0]), F.lit(self.points[-1])
        x = F.col("_x")
        inside = (x >= low if self.closed_low else x > low) & (x <= high)
        found = with_slot(df.withColumn("_x", number(c)), "_x", self.points[1:-1], out="_slot")
        return found.withColumn(out, F.when(inside, F.col("_slot")).otherwise(F.lit(-1)).cast("int")).drop("_x", "_slot")

    def ends_of(self, bin_id: Column) -> tuple[Column, Column]:
        """Lower and upper end of a bin; null for the missing bin."""
        points = F.array(*[F.lit(float(p)) for p in self.points])
        return (
            F.when(bin_id >= 0, F.element_at(points, bin_id + 1)),
            F.when(bin_id >= 0, F.element_at(points, bin_id + 2)),
        )

    def frame(self, df: DataFrame) -> DataFrame:
        """The bins as rows ``(bin_id, lo, hi)``."""
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(self.points, self.points[1:]))]
        return literal(df.sparkSession, rows, "bin_id int, lo double, hi double")


def explicit(points: Sequence[float], minimum: int = 2) -> Edges:
    """Edges from a given list; disorder and too few points raise."""
    if len(points) < minimum:
        raise ValueError(f"at least {minimum} breakpoints are needed")
    return Edges(tuple(float(p) for p in points))


def value_range(df: DataFrame, col: str) -> tuple[float, float] | None:
    """Smallest and largest value, or None without values."""
    row = df.agg(F.min(number(col)).alias("lo"), F.max(number(col)).alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def _rounded(points: list[float], digits: int) -> tuple[float, ...]:
    """Half-even rounding, with more digits where edges would coincide."""
    while True:
        short = [float(p) for p in np.round(points, digits)]
        if len(set(short)) == len(points) or digits > 16:
            return tuple(short)
        digits += 1


def even_width(df: DataFrame, col: str, n: int, precision: int | None = None) -> Edges:
    """``n`` equally wide bins over the value range.

    ``precision`` rounds the edges to that many digits, after lowering the first
    by 0.1% of the range, as display labels of such bins do.
    """
    found = value_range(df, col)
    if found is None:
        raise ValueError(f"{col} has no values")
    lo, hi = found
    if lo == hi:
        pad = 0.001 * abs(lo) if lo != 0 else 0.001
        lo, hi = lo - pad, hi + pad
    points = [lo + (hi - lo) * i / n for i in range(n)] + [hi]
    if precision is None:
        return Edges(tuple(points), closed_low=True)
    points[0] -= (hi - lo) * 0.001
    return Edges(_rounded(points, precision))


def even_depth(
    df: DataFrame, col: str, n: int, precision: int | None = None, exact: bool = True
) -> Edges:
    """Up to ``n`` equally filled bins; equal breakpoints collapse."""
    fractions = [i / n for i in range(n + 1)]
    points = quantiles(df, {"v": number(col)}, fractions, exact=exact)["v"]
    if points[0] is None:
        raise ValueError(f"{col} has no values")
    unique = sorted(set(points))
    if len(unique) == 1:
        return Edges((unique[0] - 0.001, unique[0]))
    if precision is None:
        return Edges(tuple(unique), closed_low=True)
    unique[0] -= 10.0 ** -precision
    return Edges(_rounded(unique, precision))


def drop_empty(df: DataFrame, col: str, edges: Edges) -> Edges:
    """Merge every bin without rows into its upper neighbour."""
    used = {r["b"] for r in edges.assign(df.select(col), col, "b").select("b").where("b >= 0").distinct().collect()}
    inner = [edges.points[i + 1] for i in range(edges.n_bins) if i in used]
    low = edges.points[min(used)] if used else edges.points[0]
    return replace(edges, points=(low, *inner)) if inner else edges


def outer(
    edges: Edges,
    left: float | None = None,
    right: float | None = None,
    edge: str | None = None,
    span: tuple[float, float] | None = None,
) -> Edges:
    """Replace the outermost breakpoints.

    ``edge`` is ``'inf'`` (open ends) or ``'range'`` (the data range ``span``
    widened by 0.5% on both sides) and overrides ``left`` and ``right``.
    """
    points = list(edges.points)
    if edge == "inf":
        left, right = -INF, INF
    elif edge == "range":
        if span is None:
            raise ValueError("edge='range' needs the data range")
        pad = (span[1] - span[0]) * 0.005
        left, right = span[0] - pad, span[1] + pad
    elif edge is not None:
        raise ValueError(f"unknown edge policy {edge!r}")
    closed = edges.closed_low
    if left is not None:
        points[0] = left
        closed = False
    if right is not None:
        points[-1] = right
    return Edges(tuple(points), closed_low=closed)


def breakpoints(
    df: DataFrame,
    col: str,
    label: str | None = None,
    method: str = "even_width",
    n: int = 10,
    left: float | None = None,
    right: float | None = None,
    edge: str | None = None,
    precision: int | None = None,
    exact: bool = True,
    **tree_options,
) -> Edges:
    """Breakpoints by method: ``even_width``/``w``, ``even_depth``/``d`` or a tree metric."""
    if method in TREE_METHODS:
        from .tree import grow_tree, tree_edges

        nodes = grow_tree(df, [col], label, metric=method, **tree_options)
        # a tree without an outer-edge choice is closed off by the data range
        policy = edge or ("range" if left is None and right is None else None)
        return tree_edges(nodes, col, value_range(df, col), left=left, right=right, edge=policy)
    if method in ("even_width", "w"):
        found = even_width(df, col, n, precision)
    elif method in ("even_depth", "d"):
        found = even_depth(df, col, n, precision, exact)
    else:
        raise ValueError(f"unknown method {method!r}")
    span = value_range(df, col) if edge == "range" else None
    return outer(drop_empty(df, col, found), left, right, edge, span)
