"""Cross-validation by sums over folds: every training part is the whole less its fold.

Rows that agree in label and features are counted once, with the folds they fall into in every round.
Bernoulli naive Bayes needs one pass: counts by (round, fold, class) give all models, of any subset of the
features.  Logistic regression takes Newton steps: one pass sums gradients and Hessians of all models at
once, so a step costs one scan whatever the number of rounds, folds and feature subsets.  Scores are measured the same
way: a row's count goes to the test side of its fold and the rest to the training side.

Only sums reach the driver: (models x features^2) numbers, in blocks of ``CELLS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .evaluate import measures_of_counts
from .sampling import stratified_folds

#: Numbers that a task sums for a block of models.
CELLS = 2_000_000
#: Newton steps end when no coefficient moves by more, or after so many.
TOLERANCE, STEPS = 1e-7, 15
#: Added to the Hessian's diagonal for each row, which keeps separable folds finite.
RIDGE = 1e-9
#: Scores that agree to so many decimals are equal.
DIGITS = 9


@dataclass(frozen=True)
class FoldModel:
    """A linear score of a subset of the features, trained without one fold of one round."""

    subset: int
    round: int
    fold: int
    intercept: float
    weights: tuple[float, ...]


@dataclass(frozen=True)
class FoldCounts:
    """``rows``: ``(y, x, whole, held)``, ``held`` listing ``(cell, n)`` of the row's folds, cell ``round * n_fold + fold``."""

    rows: DataFrame
    n_round: int
    n_fold: int
    width: int

    @property
    def cells(self) -> int:
        return self.n_round * self.n_fold


def fold_counts(df: DataFrame, key: str, label: str, features: str, n_fold: int = 10, n_round: int = 10, seed: int = 7) -> FoldCounts:
    vector = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(F.col(features))
    rows = materialise(df.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"), vector.alias("_x")), "fold-rows")
    folded = rows
    for r in range(n_round):
        folded = stratified_folds(folded, "_key", "_y", n_fold, seed + r, f"_f{r}")
    cells = F.array(*[F.col(f"_f{r}") + r * n_fold for r in range(n_round)])
    counted = folded.where("_y IS NOT NULL").select("_y", "_x", F.explode(cells).alias("cell")).groupBy("_y", "_x", "cell").agg(F.count("*").alias("n"))
    merged = counted.groupBy(F.col("_y").alias("y"), F.col("_x").alias("x")).agg(
        (F.sum("n") / n_round).cast("bigint").alias("whole"), F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))
    stored = materialise(merged, "fold-counts")
    width = (stored.select(F.size("x").alias("n")).first() or [0])[0]
    return FoldCounts(stored, n_round, n_fold, width)


def _batches(batches, width: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(x, y, whole, held)`` of some rows at a time, ``held`` with a column for each cell."""
    for batch in batches:
        for start in range(0, len(batch), 2_048):
            part = batch.slice(start, 2_048)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            where, counts = part.column("cells"), part.column("counts")
            held = np.zeros((len(part), cells))
            row = np.repeat(np.arange(len(part)), np.diff(where.offsets.to_numpy()))
            held[row, where.flatten().to_numpy()] = counts.flatten().to_numpy()
            yield x.astype(float), part.column("y").to_numpy().astype(float), part.column("whole").to_numpy().astype(float), held


def _summed(counts: FoldCounts, part: Callable, size: int) -> np.ndarray:
    """Sums over all rows of ``part(x, y, whole, held)``, an array of ``size`` numbers."""
    width, cells = counts.width, counts.cells

    def run(batches):
        total = np.zeros(size)
        for rows in _batches(batches, width, cells):
            total += part(*rows).ravel()
        at = np.flatnonzero(total)
        yield pa.record_batch({"i": pa.array(at), "v": pa.array(total[at])})

    out = np.zeros(size)
    for i, v in counts.rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def bernoulli_models(counts: FoldCounts, subsets: Sequence[Sequence[int]]) -> list[FoldModel]:
    """Bernoulli naive Bayes with add-one counts; features are 0 or 1."""
    cells, wide = counts.cells, counts.width + 1

    def part(x, y, whole, held):
        # rows and present features by class, of the whole and of each cell
        parts = np.column_stack([whole, held])
        ones = np.column_stack([np.ones(len(x)), x])
        return np.stack([(parts * (y == c)[:, None]).T @ ones for c in (0, 1)])

    sums = _summed(counts, part, 2 * (cells + 1) * wide).reshape(2, cells + 1, wide)
    trained = sums[:, :1] - sums[:, 1:]
    n = trained[:, :, 0]
    present = (trained[:, :, 1:] + 1) / (n[:, :, None] + 2)
    on, off = np.log(present[1] / present[0]), np.log((1 - present[1]) / (1 - present[0]))
    prior = np.log((n[1] + 1) / (n[0] + 1))
    found = []
    for s, subset in enumerate(subsets):
        chosen = np.zeros(counts.width, bool)
        chosen[list(subset)] = True
        for c in range(cells):
            found.append(FoldModel(
                s, c // counts.n_fold, c % counts.n_fold, float(prior[c] + off[c][chosen].sum()),
                tuple(np.where(chosen, on[c] - off[c], 0.0).tolist())))
    return found


def logistic_models(counts: FoldCounts, subsets: Sequence[Sequence[int]]) -> list[FoldModel]:
    """Logistic regression without a penalty, by Newton steps of all models together."""
    wide = counts.width + 1
    a, b = np.triu_indices(wide)
    chosen = np.zeros((len(subsets), wide), bool)
    chosen[:, 0] = True
    for s, subset in enumerate(subsets):
        chosen[s, [i + 1 for i in subset]] = True
    plan = [(s, c) for s in range(len(subsets)) for c in range(counts.cells)]
    block, found = max(1, CELLS // (wide + len(a))), []
    for start in range(0, len(plan), block):
        models = plan[start:start + block]
        cell, use = np.array([c for _, c in models]), chosen[[s for s, _ in models]]
        beta = np.zeros((len(models), wide))
        moving = np.arange(len(models))
        for _ in range(STEPS):
            now = cell[moving]

            def part(x, y, whole, held, beta=beta[moving], now=now):
                ones = np.column_stack([np.ones(len(x)), x])
                weight = whole[:, None] - held[:, now]
                p = 1 / (1 + np.exp(-np.clip(ones @ beta.T, -500, 500)))
                gradient = (weight * (p - y[:, None])).T @ ones
                return np.column_stack([gradient, (weight * p * (1 - p)).T @ (ones[:, a] * ones[:, b]), weight.sum(axis=0)])

            sums = _summed(counts, part, len(moving) * (wide + len(a) + 1)).reshape(len(moving), -1)
            hessian = np.zeros((len(moving), wide, wide))
            hessian[:, a, b] = hessian[:, b, a] = sums[:, wide:-1]
            used = use[moving]
            hessian *= used[:, :, None] & used[:, None, :]
            diagonal = np.arange(wide)
            hessian[:, diagonal, diagonal] += np.where(used, RIDGE * sums[:, -1:], 1.0)
            step = np.linalg.solve(hessian, (sums[:, :wide] * used)[:, :, None])[:, :, 0]
            # a long step, on the way to a separating plane, is cut
            step *= np.minimum(1, 5 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))
            beta[moving] -= step
            moving = moving[np.abs(step).max(axis=1) > TOLERANCE]
            if not len(moving):
                break
        found += [FoldModel(s, c // counts.n_fold, c % counts.n_fold, float(w[0]), tuple(w[1:].tolist())) for (s, c), w in zip(models, beta)]
    return found


MODELS = {"bnb": bernoulli_models, "lr": logistic_models}


def fold_measures(counts: FoldCounts, models: Sequence[FoldModel], n_bin: int) -> DataFrame:
    """``(subset, round, fold, side, auc, ks)`` of every model on its training rows and on its fold."""
    weights = np.array([m.weights for m in models]).reshape(len(models), counts.width)
    starts = np.array([m.intercept for m in models])
    cell = np.array([m.round * counts.n_fold + m.fold for m in models])
    block, width, cells, total = max(1, CELLS // 2_048), counts.width, counts.cells, len(models)

    def run(batches):
        for x, y, whole, held in _batches(batches, width, cells):
            for a in range(0, total, block):
                part = slice(a, a + block)
                scores = np.round(x @ weights[part].T + starts[part], DIGITS) + 0.0
                for side, n in (("train", whole[:, None] - held[:, cell[part]]), ("test", held[:, cell[part]])):
                    row, m = np.nonzero(n)
                    positive = y[row] == 1
                    some = n[row, m].astype(np.int64)
                    yield pa.record_batch({
                        "model": pa.array(m + a), "side": pa.array(np.full(len(m), side)), "score": pa.array(scores[row, m]),
                        "p": pa.array(np.where(positive, some, 0)), "n": pa.array(np.where(positive, 0, some))})

    scored = counts.rows.mapInArrow(run, "model long, side string, score double, p long, n long")
    measured = measures_of_counts(scored.select(F.concat_ws(":", "model", "side").alias("subset"), "score", "p", "n"), n_bin)
    bits = F.split("subset", ":")
    model = bits[0].cast("int")
    names = {n: F.get(F.lit(np.array([getattr(m, n) for m in models], np.int32)), model) for n in ("subset", "round", "fold")}
    return measured.select(*[c.alias(n) for n, c in names.items()], bits[1].alias("side"), "auc", "ks")
