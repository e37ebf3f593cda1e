"""Class balancing: undersampling the majority and synthetic minority rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions import hash_halves, hash_text, hash_unit
from ..plans.hash_rank import hash_ranked
from ..session import literal, materialise

NEIGHBOURS = 5
BLOCK_ROWS = 1_024
STRIP = 256  # rows compared at once
SALT_ROWS = 1_000_000
GROUPS = 8  # of rows that are compared group by group, at least
TILE_VALUES = 1 << 22  # numbers in a group
COMPARED = 2_048  # rows a strip is compared with at once
ROUNDING = 1e-12  # of squared distances, as a share of the largest squared norm


def _class_sizes(df: DataFrame, label: str, pos, neg) -> tuple[int, int]:
    row = df.agg(
        F.count_if(F.col(label) == F.lit(pos)).alias("p"), F.count_if(F.col(label) == F.lit(neg)).alias("n")
    ).first()
    return int(row["p"]), int(row["n"])


def _draws(df: DataFrame, size: int, population: int, seed: int) -> DataFrame:
    """``size`` reproducible draws of a 1-based position with replacement."""
    first, second = hash_halves(hash_text("id", seed))
    return df.sparkSession.range(size).select(
        F.col("id").alias("draw"), (first % F.lit(population) + 1).alias("position"), second.alias("spare")
    )


def undersample(
    df: DataFrame, key: str, label: str, ratio: float = 1.0, seed: int = 7, replace: bool = True, pos=1, neg=0
) -> DataFrame:
    """All minority rows plus ``floor(minority / ratio)`` majority rows.

    With replacement a majority row can be drawn several times.  Rows of other
    labels are dropped.
    """
    n_pos, n_neg = _class_sizes(df, label, pos, neg)
    size = math.floor(n_pos / ratio)
    majority = hash_ranked(df.where(F.col(label) == F.lit(neg)), key, seed, rank_col="_rank")
    if replace:
        drawn = _draws(df, size, n_neg, seed).join(majority, F.col("position") == F.col("_rank"))
    else:
        if size > n_neg:
            raise ValueError(f"{size} majority rows wanted, {n_neg} present")
        drawn = majority.where(F.col("_rank") <= size)
    return drawn.select(*df.columns).unionByName(df.where(F.col(label) == F.lit(pos)))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices, to within ``ROUNDING`` of the squared norms."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _block(keys, flat) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(list(keys))
    return keys, np.asarray(flat, dtype="float64").reshape(len(keys), -1)


def _distinct_vectors(rows: DataFrame, copies: int, n: int) -> DataFrame:
    """One row per distinct vector with its ``copies`` smallest keys, the first of which names it.

    Copies are cut down within salted groups first, so a vector that very many
    rows share is never gathered.
    """
    salt = F.pmod(F.xxhash64("key"), F.lit(max(1, n // SALT_ROWS)))
    first = rows.withColumn("_salt", salt)
    first = first.withColumn("_i", F.row_number().over(W.partitionBy("x", "_salt").orderBy("key"))).where(F.col("_i") <= copies)
    return first.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("key")), 1, copies).alias("keys")).select(
        F.col("keys")[0].alias("id"), "x", "keys")


def _along(points: np.ndarray) -> list[int]:
    """The points in an order in which near ones mostly follow each other: halves along the widest axis, and so on."""
    order, stack = [], [np.arange(len(points))]
    while stack:
        some = stack.pop()
        if len(some) == 1:
            order.append(int(some[0]))
            continue
        axis = np.ptp(points[some], axis=0).argmax()
        some = some[np.argsort(points[some, axis], kind="stable")]
        stack += [some[len(some) // 2:], some[:len(some) // 2]]
    return order


def _nearest_vectors(reps: DataFrame, m: int, k: int, block_rows: int, cells: int | None) -> DataFrame:
    """The ``k`` nearest other vectors of each: ``(id, hits)``, an array of (distance, other id)."""
    spark = reps.sparkSession
    n_cells = max(1, min(cells or math.isqrt(m), m // block_rows))
    # at most the square root of the rows reaches the driver
    pivots = np.array([r["x"] for r in reps.orderBy(hash_text("id", 0)).limit(n_cells).collect()], dtype="float64")
    norm = reps.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]
    slack = 4 * ROUNDING * norm
    # candidates are found in single precision where that cannot overflow, within its rounding; all that counts is computed in double
    single = pivots.shape[1] < 1 << 16 and 1e-20 < norm < 1e30
    kind, rough = ("float32", slack + 4 * (pivots.shape[1] + 8) * 2.0 ** -23 * norm) if single else ("float64", slack)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), STRIP):
                part = b.iloc[start:start + STRIP]
                d = _squares(_vectors(part["x"]), pivots)
                near = d.argmin(axis=1)
                yield part.assign(cell=near.astype("int32"), own=np.sqrt(d[np.arange(len(part)), near] + slack))

    id_type = reps.schema["id"].dataType
    placed_type = T.StructType([
        T.StructField("id", id_type), T.StructField("x", T.ArrayType(T.DoubleType())),
        T.StructField("cell", T.IntegerType()), T.StructField("own", T.DoubleType())])
    placed = materialise(reps.select("id", "x").mapInPandas(place, placed_type), "cells")
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("radius")).collect()  # one row per cell
    size, radius = np.zeros(n_cells, dtype="int64"), np.zeros(n_cells)
    for r in found:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    counts = {r["cell"]: -(-r["n"] // block_rows) for r in found}
    n_groups = max(GROUPS, -(-m * pivots.shape[1] // TILE_VALUES))
    units, in_group, reached = [], np.zeros((n_cells, n_groups), dtype=bool), 0
    for c in _along(pivots):
        for part in range(counts.get(c, 0)):
            group = min(n_groups - 1, int(reached * n_groups / m))
            units.append((c, counts[c], part, group))
            in_group[c, group] = True
            reached += size[c] / counts[c]
    units = literal(spark, units, "cell int, parts int, part int, grp int")
    parts = units.select("cell", "parts").distinct()
    first, _ = hash_halves(hash_text("id", 1))
    members = F.collect_list(F.struct("id", "x", "own")).alias("m")
    blocks = placed.join(F.broadcast(parts), "cell").withColumn("part", (first % F.col("parts")).cast("int")).join(
        F.broadcast(units.drop("parts")), ["cell", "part"]).groupBy("cell", "part", "grp").agg(members)
    blocks = blocks.select("cell", "grp", F.col("m.id").alias("keys"), F.flatten("m.x").alias("flat"), F.col("m.own").alias("own"))

    def wanted_cells(x: np.ndarray, own: np.ndarray, bound: np.ndarray, cells) -> np.ndarray:
        """The cells that may hold something within the bound of a row."""
        far = np.sqrt(np.maximum(_squares(x, pivots[cells]) - slack, 0))
        # by the triangle inequality, and as the other cell's rows are nearer to its pivot
        least = np.maximum(far - radius[cells], (far - own[:, None] - math.sqrt(2 * slack)) / 2)
        return (least <= bound[:, None]) & (size[cells] > 0)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every row with the distance none of its neighbours exceeds and the groups that may hold one."""
        for b in batches:
            for cell, group, all_keys, flat, all_own in zip(b["cell"], b["grp"], b["keys"], b["flat"], b["own"]):
                keys, x = _block(all_keys, flat)
                own, bound = np.asarray(all_own), np.full(len(x), np.inf)
                if len(x) > k:
                    for start in range(0, len(x), STRIP):
                        d = _squares(x[start:start + STRIP], x)
                        d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
                        bound[start:start + STRIP] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
                else:
                    # the nearest cells that hold enough rows, wherever in them these lie
                    most = np.sqrt(_squares(x, pivots) + slack) + radius
                    order = np.argsort(most, axis=1)
                    enough = (np.cumsum(size[order], axis=1) > k).argmax(axis=1)
                    bound = most[np.arange(len(x)), order[np.arange(len(x)), enough]]
                wanted = wanted_cells(x, own, bound, slice(None)) @ in_group
                yield pd.DataFrame({
                    "id": keys, "x": list(x), "cell": np.full(len(x), cell, "int32"), "grp": np.full(len(x), group, "int32"), "own": own,
                    "bound": bound, "wants": [np.flatnonzero(w).astype("int32") for w in wanted]})

    asked = materialise(blocks.mapInPandas(reach, T.StructType([
        *placed_type.fields[:3], T.StructField("grp", T.IntegerType()), T.StructField("own", T.DoubleType()),
        T.StructField("bound", T.DoubleType()), T.StructField("wants", T.ArrayType(T.IntegerType()))])), "reach")
    queries = asked.select("id", "x", "cell", "own", "bound", F.col("grp").alias("h"), F.explode("wants").alias("g"))
    # at most the square of the number of groups
    pairs = queries.select(F.col("g").alias("into"), F.col("h").alias("whence")).distinct()
    others = asked.select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("cell").alias("there"), F.col("grp").alias("into")).join(
        F.broadcast(pairs), "into")
    hit_type = T.StructType([
        T.StructField("id", id_type), T.StructField("other", id_type), T.StructField("distance", T.DoubleType())])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The nearest rows of one group for the rows of another."""
        found = []
        if len(left) and len(right):
            left, right = left.sort_values("cell", kind="stable"), right.sort_values("there", kind="stable")
            names, x, own, bound = np.array(list(left["id"])), _vectors(left["x"]), left["own"].to_numpy(), left["bound"].to_numpy()
            others, y, cells = np.array(list(right["other"])), _vectors(right["y"]), right["there"].to_numpy()
            here, begins = np.unique(cells, return_index=True)
            ends, yy = np.append(begins[1:], len(cells)), (y * y).sum(axis=1).astype(kind)
            x_rough, y_rough = x.astype(kind) * -2, y.astype(kind)
            for start in range(0, len(x), STRIP):
                some = slice(start, start + STRIP)
                a, limit = x[some], bound[some] ** 2 + rough
                visit = np.flatnonzero(wanted_cells(a, own[some], bound[some], here).any(axis=0))
                at = np.concatenate([np.arange(begins[c], ends[c]) for c in visit]) if len(visit) else np.empty(0, "int64")
                best = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
                aa = (a * a).sum(axis=1)[:, None]
                for low in range(0, len(at), COMPARED):
                    few = at[low:low + COMPARED]
                    d = x_rough[some] @ y_rough[few].T
                    d += yy[few]
                    i, j = np.nonzero(d <= (limit[:, None] - aa + rough).astype(kind))
                    if len(i) > 8 * (k + 1) * len(a) and len(few) > k + 1:
                        # the row itself may be among them
                        near = np.partition(d, k, axis=1)[:, k] + 2 * rough
                        i, j = np.nonzero(d <= np.minimum(limit - aa[:, 0] + rough, near)[:, None].astype(kind))
                    other = few[j]
                    differs = names[some][i] != others[other]
                    i, other = i[differs], other[differs]
                    exact = np.sqrt(((a[i] - y[other]) ** 2).sum(axis=1))
                    i, other, exact = (np.concatenate(p) for p in zip(best, (i, other, exact)))
                    order = np.lexsort((others[other], exact, i))
                    i, other, exact = i[order], other[order], exact[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    last = rank == k - 1
                    limit[i[last]] = np.minimum(limit[i[last]], exact[last] ** 2 + rough)
                    best = i[rank < k], other[rank < k], exact[rank < k]
                found.append(pd.DataFrame({"id": names[some][best[0]], "other": others[best[1]], "distance": best[2]}))
        return pd.concat(found) if found else pd.DataFrame({"id": [], "other": [], "distance": []})

    hits = queries.groupBy("g", "h").cogroup(others.groupBy("into", "whence")).applyInPandas(compare, hit_type)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k)
    return hits.groupBy("id").agg(best.alias("hits"))


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, k: int, block_rows: int = BLOCK_ROWS, cells: int | None = None
) -> DataFrame:
    """Exact ``k`` nearest other rows by Euclidean distance: ``(key, rank, neighbour, distance)``.

    Equal vectors are searched once.  Vectors gather in the cell of their nearest
    pivot, of which there are about the square root of their number, and cells
    are cut into blocks of bounded size.  A row's ``k``-th distance inside its
    block bounds its search: it visits only the cells that may hold something
    nearer.  Cells travel in groups, of which there are ``GROUPS`` or as many as keep
    a group in memory: a row is sent once to each group where it visits a cell, and
    only its nearest ``k`` there leave a task.  Where the data
    has no structure (very many dimensions) the work stays quadratic, as exact
    search is.  Ties go to the smaller key; vectors must not be null.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    n = rows.count()
    if n <= k:
        raise ValueError(f"{k} neighbours need more than {n} rows")
    reps = materialise(_distinct_vectors(rows, k + 1, n), "vectors")
    m = reps.count()
    # each row's own vector and the k nearest others hold its neighbours
    own = reps.select("id", F.lit(0.0).alias("distance"), F.explode("keys").alias("neighbour"))
    if m > 1:
        hits = _nearest_vectors(reps, m, min(k, m - 1), block_rows, cells)
        others = hits.select("id", F.explode("hits").alias("h")).select("id", "h.distance", F.col("h.other").alias("other"))
        copies = reps.select(F.col("id").alias("other"), F.explode("keys").alias("neighbour"))
        own = own.unionByName(others.join(copies, "other").drop("other"))
    near = own.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("near"))
    named = rows.join(reps.select("id", "x"), "x").select("key", "id").join(near, "id")
    others = F.slice(F.filter("near", lambda h: h["neighbour"] != F.col("key")), 1, k)
    return named.select("key", F.posexplode(others).alias("pos", "hit")).select(
        "key", (F.col("pos") + 1).alias("rank"), "hit.neighbour", "hit.distance")


def synthetic_minority(
    df: DataFrame, key: str, vector: str, label: str, ratio: float = 1.0, k: int = NEIGHBOURS, seed: int = 7,
    pos=1, neg=0, **blocks,
) -> DataFrame:
    """New minority rows ``(draw, base, neighbour, step, vector)`` so that minority / majority reaches ``ratio``.

    Each lies on the segment from a random minority row to one of its ``k``
    nearest minority rows.
    """
    n_pos, n_neg = _class_sizes(df, label, pos, neg)
    wanted = math.floor(ratio * n_neg) - n_pos
    if wanted < 0:
        raise ValueError(f"the minority already exceeds ratio {ratio}")
    minority = df.where(F.col(label) == F.lit(pos)).select(
        F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")
    )
    k = min(k, n_pos - 1)
    draws = _draws(df, wanted, n_pos, seed).select(
        "draw", "position", (F.col("spare") % F.lit(k) + 1).cast("int").alias("rank"),
        hash_unit(hash_text("draw", seed + 1)).alias("step"),
    )
    base = hash_ranked(minority, "key", seed, rank_col="position")
    near = nearest_neighbours(minority, "key", "x", k, **blocks).select("key", "rank", "neighbour")
    partner = minority.select(F.col("key").alias("neighbour"), F.col("x").alias("nx"))
    moved = F.zip_with("x", "nx", lambda a, b: a + F.col("step") * (b - a))
    return (
        draws.join(base, "position").join(near, ["key", "rank"]).join(partner, "neighbour")
        .select("draw", F.col("key").alias("base"), "neighbour", "step", moved.alias(vector))
    )


class Resampler:
    """Class balancing for cross-validation: ``under`` or ``smote``, on the training part only."""

    def __init__(self, method: str = "smote", ratio: float = 1.0, seed: int = 7, **options):
        if method not in ("smote", "under"):
            raise ValueError("method must be smote or under")
        self.method, self.ratio, self.seed, self.options = method, ratio, seed, options

    def __call__(self, df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
        if self.method == "under":
            return undersample(df, key, label, self.ratio, self.seed, **self.options)
        new = synthetic_minority(df, key, vector, label, self.ratio, seed=self.seed, **self.options)
        pos = self.options.get("pos", 1)
        kind = df.schema[vector].dataType.elementType
        rows = new.select(
            F.lit(None).cast(df.schema[key].dataType).alias(key), F.transform(vector, lambda v: v.cast(kind)).alias(vector),
            F.lit(pos).cast(df.schema[label].dataType).alias(label),
        )
        return df.select(key, vector, label).unionByName(rows)
