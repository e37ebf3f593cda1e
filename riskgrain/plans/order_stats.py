"""Exact order statistics without a global sort.

A rank is found by narrowing a value interval: approximate quantiles propose
narrow intervals around the wanted ranks, and one more pass counts everything
outside them in bulk and every distinct value inside.  Running sums over those
few counts give the exact values.  A few ranks of data of any size need a few
column-pruned scans and no full shuffle.  Where the wanted ranks are so many that
their intervals cover much of the table, the distinct values are counted in
buckets instead, so no task holds more than a set number of them.
A value that fills a large share of the rows is an interval of its own and
collapses to one counted row, so heavy ties cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SMALL = 200_000
ACCURACY = 10_000
LITERAL_KEYS = 1_000
TREE_TESTS = 24
ONLY = "v"

Ranks = dict[str, Sequence[int]]


class RankValue(NamedTuple):
    """Value at a rank, with the number of smaller and of equal rows."""

    value: float
    n_less: int
    n_equal: int


def decision_tree(tests: Sequence[Column], first: int = 0) -> Column:
    """Index of the first true test among tests that turn true once and stay true.

    Built as a balanced tree, so a row evaluates about log2(n) of them.
    """
    if not tests:
        return F.lit(first)
    middle = len(tests) // 2
    return F.when(tests[middle], decision_tree(tests[:middle], first)).otherwise(
        decision_tree(tests[middle + 1:], first + middle + 1)
    )


def count_below(x: Column, edges: Column, n: int | Column, most: int) -> Column:
    """How many of the ascending array's first ``n`` entries are smaller than ``x``, by binary search."""
    steps = [1 << i for i in range(max(1, most).bit_length() - 1, -1, -1)]

    def move(at: Column, step: Column) -> Column:
        return F.when((at + step <= n) & (F.get(edges, at + step - 1) < x), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), move)


def slot_of(x: Column, edges: Sequence[float]) -> Column:
    """Number of ascending edges smaller than ``x``: compiled tests for few edges, a search for many."""
    if len(edges) <= TREE_TESTS:
        return decision_tree([x <= F.lit(e) for e in edges])
    return count_below(x, F.array(*[F.lit(e) for e in edges]), len(edges), len(edges))


def with_slot(df: DataFrame, x: str, edges: Column | Sequence, n: Column | int | None = None, most: int = 0, out: str = "slot") -> DataFrame:
    """Add the number of ascending edges smaller than column ``x``.

    A binary search written as one small projection per step: every step is
    compiled, whereas one expression over many edges grows too large for that.
    """
    if not isinstance(edges, Column):
        n = most = len(edges)
        edges = F.array(*[F.lit(e) for e in edges]) if most else F.array(F.lit(None).cast("double"))
    kept = df.columns
    df = df.withColumn("_at", F.lit(0))
    step = 1 << max(1, most).bit_length() - 1
    while step:
        further = (F.col("_at") + step <= n) & (F.get(edges, F.col("_at") + (step - 1)) < F.col(x))
        df = df.withColumn("_at", F.when(further, F.col("_at") + step).otherwise(F.col("_at")))
        step //= 2
    # a one-element generator keeps later filters on the slot from being rewritten
    # into the steps, where every step would be expanded three times
    return df.select(*kept, F.explode(F.array("_at")).alias(out))


def long_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows ``(k, v)`` of one or several columns of the same type, nulls dropped."""
    if len(columns) == 1:
        ((name, c),) = columns.items()
        rows = df.select(F.lit(name).alias("k"), c.alias("v"))
    else:
        rows = df.select(*[c.alias(n) for n, c in columns.items()]).unpivot([], list(columns), "k", "v")
    return rows.where("v is not null")


def _just_below(v):
    return v - 1 if isinstance(v, int) else math.nextafter(v, -math.inf)


def _around(fractions: Sequence[float], spread: float) -> list[float]:
    return sorted({min(1.0, max(0.0, f + d)) for f in fractions for d in (-spread, spread)})


def _propose(rows: DataFrame, fractions: Sequence[float], accuracy: int) -> tuple[dict[str, int], dict[str, dict[float, float]]]:
    """Row counts and approximate quantiles per key, in one pass; for few keys (``quantile_table`` serves many)."""
    found = (
        rows.groupBy("k")
        .agg(F.count("*").alias("n"), F.percentile_approx("v", fractions, accuracy).alias("q"))
        .collect()
    )
    return {r["k"]: r["n"] for r in found}, {r["k"]: dict(zip(fractions, r["q"])) for r in found}


def _intervals(wanted: Sequence[float], quantile: dict[float, float], spread: float) -> list[tuple]:
    """Disjoint closed intervals around the wanted fractions, ascending."""
    at = sorted(quantile)
    spans = []
    for f in wanted:
        lo = max((a for a in at if a <= f - spread), default=at[0])
        hi = min((a for a in at if a >= f + spread), default=at[-1])
        spans.append((quantile[lo], quantile[hi]))
    merged: list[list] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return [tuple(m) for m in merged]


def _with_cells(rows: DataFrame, intervals: dict[str, list[tuple]]) -> DataFrame:
    """Add the cell of each row: odd inside an interval, even in the gap before it."""
    bounds = {k: [e for lo, hi in spans for e in (_just_below(lo), hi)] for k, spans in intervals.items()}
    if len(bounds) == 1:
        ((_, edges),) = bounds.items()
        return with_slot(rows, "v", edges, out="cell")
    arrays = F.create_map(*[c for k, es in bounds.items() for c in (F.lit(k), F.array(*[F.lit(e) for e in es]))])
    edges = F.try_element_at(arrays, F.col("k"))
    known = rows.where(F.col("k").isin(list(bounds))).withColumn("_edges", edges)
    most = max(len(e) for e in bounds.values())
    return with_slot(known, "v", F.col("_edges"), F.size("_edges"), most, "cell").drop("_edges")


def _count_cells(rows: DataFrame, ranks: Ranks, inner: bool, small: int | None = None) -> dict[str, dict[int, RankValue]]:
    """Exact values at ranks from rows ``(k, v[, cell])``; ranks that fall into a gap are left out.

    ``small`` is given where nothing bounds the rows of a key: they are then
    counted in buckets of about that many distinct values.
    """
    if small is not None:
        from .prefix import running_totals

        value = F.when(F.col("cell") % 2 == 1, F.col("v")) if inner else F.col("v")
        placed = rows.select("k", F.struct(F.col("cell") if inner else F.lit(0).alias("cell"), value.alias("v")).alias("x"))
        totals = running_totals(placed, "x", {"n": F.count("*")}, ["k"], bucket_rows=small)
        ranked = totals.select("k", "x.v", "n", F.col("cum_n").alias("upto"))
    elif inner:
        value = F.when(F.col("cell") % 2 == 1, F.col("v"))
        sizes = rows.groupBy("k", "cell", value.alias("v")).agg(F.count("*").alias("n"))
        order = W.partitionBy("k").orderBy("cell", "v")
    else:
        sizes = rows.groupBy("k", "v").agg(F.count("*").alias("n"))
        order = W.partitionBy("k").orderBy("v")
    if small is None:
        ranked = sizes.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    wanted = {k: sorted(set(rs)) for k, rs in ranks.items() if rs}
    lists = F.create_map(*[c for k, rs in wanted.items() for c in (F.lit(k), F.array(*[F.lit(r).cast("bigint") for r in rs]))])
    most = max(len(rs) for rs in wanted.values())
    listed = ranked.where(F.col("v").isNotNull() & F.col("k").isin(list(wanted))).select(
        "k", "v", "n", "upto", (F.col("upto") - F.col("n")).alias("first"), F.try_element_at(lists, F.col("k")).alias("_ranks")
    )
    # a rank r lies in this row if first <= r < upto
    for edge in ("first", "upto"):
        listed = with_slot(listed, edge, F.col("_ranks"), F.size("_ranks"), most, f"_{edge}")
    hits = listed.where("_upto > _first").select("k", "v", "n", "upto").collect()
    found: dict[str, dict[int, RankValue]] = {k: {} for k in ranks}
    for row in hits:
        first = row["upto"] - row["n"]
        for r in wanted[row["k"]]:
            if first <= r < row["upto"]:
                found[row["k"]][r] = RankValue(row["v"], first, row["n"])
    return found


def rank_search(
    rows: DataFrame,
    ranks: Ranks,
    counts: dict[str, int],
    *,
    small: int = SMALL,
    accuracy: int = ACCURACY,
    proposal: dict[str, dict[float, float]] | None = None,
) -> dict[str, dict[int, RankValue]]:
    """Exact values at 0-based ranks per key of rows ``(k, v)``; ``v`` is double or bigint without NaN.

    ``rows`` is scanned several times; hand in a stored table if it is costly.
    """
    ranks = {k: rs for k, rs in ranks.items() if rs}
    for k, rs in ranks.items():
        if min(rs) < 0 or max(rs) >= counts[k]:
            raise ValueError(f"ranks of {k} must lie in 0..{counts[k] - 1}")
    if not ranks:
        return {}
    if max(counts[k] for k in ranks) <= small:
        return _count_cells(rows.where(F.col("k").isin(list(ranks))) if len(counts) > len(ranks) else rows, ranks, False)

    spread = 2.0 / accuracy
    fractions = {k: [(r + 0.5) / counts[k] for r in sorted(set(rs))] for k, rs in ranks.items()}
    if proposal is None:
        everything = sorted({f for fs in fractions.values() for f in fs})
        _, proposal = _propose(rows, _around(everything, spread), accuracy)
    intervals = {k: _intervals(fs, proposal[k], spread) for k, fs in fractions.items()}
    celled = _with_cells(rows, intervals)
    # by the wanted ranks: an interval merged from many of them holds the rows of all
    widest = max(counts[k] * min(1.0, 4 * spread * len(fractions[k])) for k in ranks)
    if widest <= small:
        found = _count_cells(celled, ranks, True)
    else:
        found = _narrow(celled, ranks, counts, small, accuracy)
    # an approximate quantile may have missed its rank; the whole column then decides
    missed = {k: [r for r in rs if r not in found.get(k, {})] for k, rs in ranks.items()}
    if any(missed.values()):
        again = {k: rs for k, rs in missed.items() if rs}
        if accuracy < 100 * ACCURACY:
            extra = rank_search(rows, again, counts, small=small, accuracy=accuracy * 8)
        else:
            extra = _count_cells(rows.where(F.col("k").isin(list(again))), again, False, small)
        for k, values in extra.items():
            found.setdefault(k, {}).update(values)
    return found


def _narrow(celled: DataFrame, ranks: Ranks, counts: dict[str, int], small: int, accuracy: int) -> dict[str, dict[int, RankValue]]:
    """Search again inside the intervals, each as a key of its own."""
    sizes: dict[str, dict[int, int]] = {}
    for r in celled.groupBy("k", "cell").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["k"], {})[r["cell"]] = r["n"]
    inner_ranks: dict[str, list[int]] = {}
    inner_counts: dict[str, int] = {}
    origin: dict[str, tuple[str, int]] = {}
    for k, rs in ranks.items():
        below = 0
        for cell in sorted(sizes.get(k, {})):
            n = sizes[k][cell]
            if cell % 2 == 1:
                key = f"{k}\u0001{cell}"
                inside = [r - below for r in rs if below <= r < below + n]
                if inside:
                    inner_ranks[key], inner_counts[key], origin[key] = inside, n, (k, below)
            below += n
    inner = celled.where("cell % 2 = 1").select(F.concat_ws("\u0001", "k", "cell").alias("k"), "v")
    shrunk = max(inner_counts.values(), default=0) < max(counts[k] for k in ranks) / 2
    if shrunk:
        local = rank_search(inner, inner_ranks, inner_counts, small=small, accuracy=accuracy)
    else:
        local = _count_cells(inner.where(F.col("k").isin(list(inner_ranks))), inner_ranks, False, small)
    found: dict[str, dict[int, RankValue]] = {k: {} for k in ranks}
    for key, values in local.items():
        k, below = origin[key]
        for r, at in values.items():
            found[k][r + below] = RankValue(at.value, at.n_less + below, at.n_equal)
    return found


def ranks_by_size(
    rows: DataFrame,
    wanted: Callable[[int], Sequence[int]],
    hints: Sequence[float],
    *,
    small: int = SMALL,
    accuracy: int = ACCURACY,
) -> tuple[dict[str, int], dict[str, dict[int, RankValue]]]:
    """Values at ranks that depend on each key's size, near the fractions ``hints``.

    Counting and proposing share one pass.  Returns the sizes and the values.
    """
    spread = 2.0 / accuracy
    counts, proposal = _propose(rows, _around(hints, 2 * spread), accuracy)
    ranks = {k: list(wanted(n)) for k, n in counts.items()}
    return counts, rank_search(rows, ranks, counts, small=small, accuracy=accuracy, proposal=proposal)


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    fractions: Sequence[float],
    *,
    exact: bool = True,
    small: int = SMALL,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring order statistics.

    ``exact=False`` answers from one ``percentile_approx`` scan instead.
    A column without values gives nulls.
    """
    found = quantiles_by_key(long_rows(df, columns), fractions, exact=exact, small=small, accuracy=accuracy)
    return {n: found.get(n, [None] * len(fractions)) for n in columns}


def quantiles_by_key(
    rows: DataFrame, fractions: Sequence[float], *, exact: bool = True, small: int = SMALL, accuracy: int = ACCURACY
) -> dict[str, list[float]]:
    """The same per key of rows ``(k, v)``."""
    if not exact:
        _, found = _propose(rows, list(fractions), accuracy)
        return {k: [float(q[f]) for f in fractions] for k, q in found.items()}

    def ranks(n: int) -> list[int]:
        return sorted({k for p in fractions for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})

    counts, found = ranks_by_size(rows, ranks, fractions, small=small, accuracy=accuracy)
    result = {}
    for k, n in counts.items():
        at = found[k]
        values = []
        for p in fractions:
            x = p * (n - 1)
            lo, hi = at[math.floor(x)].value, at[math.ceil(x)].value
            values.append(lo + (hi - lo) * (x - math.floor(x)))
        result[k] = values
    return result


def filled_buckets(rows: Column, size: Column, k: Column) -> Column:
    """How many of the ``k`` near-equal runs of ``size`` rows the first ``rows`` rows fill (see ``bucket_ends``)."""
    short, longer = F.floor(size / k), size % k
    first = longer * (short + 1)
    return F.when(rows <= first, F.floor(rows / (short + 1))).otherwise(
        longer + F.floor((rows - first) / F.greatest(short, F.lit(1)))).cast("bigint")


def quantile_table(rows: DataFrame, fractions: Sequence[float], **options) -> DataFrame:
    """``(k, n, q)`` for rows ``(k, v)``: the exact quantiles of every key, however many keys there are.

    Nothing reaches the driver: running counts over the distinct values tell
    which value holds which rank.
    """
    from .prefix import running_totals

    totals = running_totals(rows, "v", {"c": F.count("*")}, ["k"], **options)
    sizes = totals.groupBy("k").agg(F.max("cum_c").alias("n")).withColumnRenamed("k", "_k")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(fractions)])
    at = F.col("w.p") * (F.col("n") - 1)
    listed = totals.join(sizes, F.col("k") == F.col("_k")).select("k", "v", "n", "c", "cum_c", F.explode(wanted).alias("w"))
    first, last = F.floor(at), F.ceil(at)
    holds = lambda r: (r >= F.col("cum_c") - F.col("c")) & (r < F.col("cum_c"))
    ends = listed.where(holds(first) | holds(last)).groupBy("k", "n", "w").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    values = ends.select("k", "n", "w.i", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - first)).alias("q"))
    return values.groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("q")).select(
        "k", "n", F.transform("q", lambda x: x["q"]).alias("q"))


class Cutoff(NamedTuple):
    """Last row of a bucket in ``(value, tie)`` order; no tie means all equal rows belong."""

    value: float
    tie: int | None


def cutoffs(
    rows: DataFrame, last_ranks: Ranks, counts: dict[str, int], *, small: int = SMALL
) -> dict[str, list[Cutoff]]:
    """Rows at the given 0-based ranks of the order ``(v, tie)`` per key of rows ``(k, v, tie)``.

    With these cut-offs every row finds its bucket by comparison alone, so rows
    are ranked into buckets without moving them.  Equal values that straddle a
    cut-off are separated by the tie column.
    """
    found = rank_search(rows.select("k", "v"), last_ranks, counts, small=small)
    tie_ranks: dict[str, list[int]] = {}
    tie_counts: dict[str, int] = {}
    tie_keys: dict[tuple, str] = {}
    for k, rs in last_ranks.items():
        for r in sorted(set(rs)):
            at = found[k][r]
            if r < at.n_less + at.n_equal - 1:
                key = tie_keys.setdefault((k, at.value), f"t{len(tie_keys)}")
                tie_ranks.setdefault(key, []).append(r - at.n_less)
                tie_counts[key] = at.n_equal
    ties: dict[str, dict[int, RankValue]] = {}
    if tie_keys:
        name = F.coalesce(
            *[F.when((F.col("k") == k) & (F.col("v") == F.lit(v)), F.lit(t)) for (k, v), t in tie_keys.items()]
        )
        tied = rows.select(name.alias("k"), F.col("tie").alias("v")).where("k is not null")
        ties = rank_search(tied, tie_ranks, tie_counts, small=small)
    result: dict[str, list[Cutoff]] = {}
    for k, rs in last_ranks.items():
        result[k] = []
        for r in rs:
            at = found[k][r]
            split = r < at.n_less + at.n_equal - 1
            result[k].append(Cutoff(at.value, ties[tie_keys[k, at.value]][r - at.n_less].value if split else None))
    return result


def bucket_ends(n: int, k: int) -> list[int]:
    """Last 0-based rank of each of ``k`` near-equal runs of ``n`` rows, the first ``n % k`` one longer."""
    size, longer = divmod(n, k)
    ends = []
    last = -1
    for i in range(k):
        last += size + (1 if i < longer else 0)
        ends.append(last)
    return ends


def bucket_of(value: Column, tie: Column, ends: Sequence[Cutoff]) -> Column:
    """0-based bucket of a row, given the last row of every bucket but the final one."""

    def upto(c: Cutoff) -> Column:
        if c.tie is None:
            return value <= F.lit(c.value)
        return (value < F.lit(c.value)) | ((value == F.lit(c.value)) & (tie <= F.lit(c.tie)))

    if len(ends) <= TREE_TESTS:
        return decision_tree([upto(c) for c in ends])
    most = (1 << 62) - 1
    edges = F.array(*[F.struct(F.lit(c.value), F.lit(most if c.tie is None else c.tie).cast("bigint")) for c in ends])
    return count_below(F.struct(value, tie.cast("bigint")), edges, len(ends), len(ends))
