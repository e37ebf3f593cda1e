"""Reproducible splits: random, stratified by exact sizes, and stratified folds.

Every row has a fixed random key, the hash of its id and a seed.  A split is a
range of that order, so only the few cut-off keys are searched for and each row
then finds its split by comparison: no shuffle, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hash_halves, hash_text
from ..plans.hash_rank import hash_ranked
from ..plans.order_stats import bucket_ends, bucket_of, cutoffs, filled_buckets
from .profile import labels_of


def _place(
    df: DataFrame, key: str, seed: int, strata: list[tuple[str, Column]], last: dict[str, list[int]],
    counts: dict[str, int], names: dict[str, Sequence],
) -> Column:
    """Name of the run a row falls into, per stratum."""
    h1, h2 = hash_halves(hash_text(key, seed))
    stratum = F.coalesce(*[F.when(test, F.lit(s)) for s, test in strata])
    rows = df.select(stratum.alias("k"), h1.alias("v"), h2.alias("tie")).where("k is not null")
    found = cutoffs(rows, last, counts)
    place = F.lit(None)
    for s, test in strata:
        run = bucket_of(h1, h2, found[s])
        named = F.element_at(F.array(*[F.lit(n) for n in names[s]]), run + 1)
        place = F.when(test, named).otherwise(place)
    return place


def _ends(sizes: Sequence[int], total: int) -> list[int]:
    """Last ranks of consecutive runs; a run that reaches the end needs no cut-off."""
    ends, last = [], -1
    for s in sizes:
        last += s
        ends.append(last)
    return [e for e in ends if e < total]


def random_split(df: DataFrame, key: str, fractions: Mapping[str, float], seed: int = 7, out: str = "split") -> DataFrame:
    """Exact random split by fractions, in the given order; a remainder gets null.

    The first split's size rounds up and the others' round down, so a first
    ``test`` split leaves the rest to draw from.
    """
    if sum(fractions.values()) > 1 + 1e-9:
        raise ValueError("fractions add up to more than 1")
    n = df.count()
    sizes = []
    for i, f in enumerate(fractions.values()):
        wanted = math.ceil(n * f - 1e-9) if i == 0 else math.floor(n * f + 1e-9)
        sizes.append(min(wanted, n - sum(sizes)))
    if any(s == 0 for s in sizes):
        raise ValueError(f"empty split: {dict(zip(fractions, sizes))} of {n} rows")
    names = {"all": [*fractions, None]}
    everyone = [("all", F.lit(True))]
    if sum(sizes) == n:
        names = {"all": list(fractions)}
    last = {"all": _ends(sizes, n)}
    if sum(sizes) == n:
        last["all"] = last["all"][:-1]
        if not last["all"]:
            return df.withColumn(out, F.lit(next(iter(fractions))))
    return df.withColumn(out, _place(df, key, seed, everyone, last, {"all": n}, names))


def nested_split(
    df: DataFrame, key: str, test_fraction: float, val_fraction: float, seed: int = 7, out: str = "split"
) -> DataFrame:
    """Test part from all rows, then validation and training from the remainder only."""
    n = df.count()
    n_test = math.ceil(n * test_fraction - 1e-9)
    n_val = math.ceil((n - n_test) * val_fraction - 1e-9)
    last = {"all": [n_test - 1, n_test + n_val - 1]}
    names = {"all": ["test", "val", "train"]}
    return df.withColumn(out, _place(df, key, seed, [("all", F.lit(True))], last, {"all": n}, names))


def stratum_sizes(size: int, negative_rate: float) -> tuple[int, int]:
    """Negatives and positives of a sample: at least one negative, the rest positive."""
    negatives = max(1, int(size * negative_rate))
    return negatives, size - negatives


def stratified_split(
    df: DataFrame, key: str, label: str, sizes: Mapping[str, int], seed: int = 7, pos=1, neg=0, out: str = "split",
    negative_rate: float | None = None,
) -> DataFrame:
    """Disjoint samples of exact sizes that keep the class mix, without replacement.

    Samples are drawn in the given order; rows drawn by none get null.  The mix
    is the table's own unless ``negative_rate`` is given.
    """
    y = F.col(label)
    classes = df.agg(
        F.count_if(y == F.lit(neg)).alias("neg"), F.count_if(y == F.lit(pos)).alias("pos"), F.count("*").alias("n")
    ).first()
    if sum(sizes.values()) > classes["n"]:
        raise ValueError(f"{sum(sizes.values())} rows wanted, {classes['n']} present")
    rate = classes["neg"] / classes["n"] if negative_rate is None else negative_rate
    wanted = [stratum_sizes(s, rate) for s in sizes.values()]
    strata, last, counts, names = [], {}, {}, {}
    for name, test, total, per_split in (
        ("neg", y == F.lit(neg), classes["neg"], [w[0] for w in wanted]),
        ("pos", y == F.lit(pos), classes["pos"], [w[1] for w in wanted]),
    ):
        if sum(per_split) > total:
            raise ValueError(f"{sum(per_split)} {name} rows wanted, {total} present")
        used = [(n, s) for n, s in zip(sizes, per_split) if s]
        if not used:
            continue
        strata.append((name, test))
        last[name] = _ends([s for _, s in used], total)
        counts[name] = total
        names[name] = [n for n, _ in used] + [None]
    return df.withColumn(out, _place(df, key, seed, strata, last, counts, names))


def _many_label_folds(df: DataFrame, key: str, label: str, k: int, seed: int, out: str) -> DataFrame:
    """The same folds from ranks in hash order, for more labels than a plan should name."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    if short := sizes.where(F.col("_size") < k).limit(10).collect():
        raise ValueError(f"labels {[r[0] for r in short]} have fewer than {k} rows")
    ranked = hash_ranked(df, key, seed, [label], "_rank").join(sizes, F.col(label) == F.col("_label"), "left")
    return ranked.withColumn(
        out, filled_buckets(F.col("_rank") - 1, F.col("_size"), F.lit(k)).cast("int")).drop("_rank", "_label", "_size")


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 7, out: str = "fold") -> DataFrame:
    """0-based fold per row; within each label the folds differ by at most one row."""
    labels = labels_of(df, label)
    if labels is None:
        return _many_label_folds(df, key, label, k, seed, out)
    tests = {f"l{i}": F.col(label) == F.lit(v) for i, v in enumerate(labels)}
    row = df.agg(*[F.count_if(t).alias(s) for s, t in tests.items()]).first()
    counts = {s: int(row[s]) for s in tests}
    if short := [v for v, c in zip(labels, counts.values()) if c < k]:
        raise ValueError(f"labels {short} have fewer than {k} rows")
    last = {s: bucket_ends(c, k)[:-1] for s, c in counts.items()}
    names = {s: list(range(k)) for s in counts}
    return df.withColumn(out, _place(df, key, seed, list(tests.items()), last, counts, names).cast("int"))
