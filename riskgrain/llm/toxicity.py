"""Toxicity by weak supervision.

Voters are words and word beginnings that a bounded sample of labelled rows ties to the
label, and fixed patterns (shouting, runs of exclamation marks, stretched letters).  Every learnable document,
labelled or not, is voted on; from the voters' second moments over all of them (texts
with the same five-grams and votes once, with the share of toxic ones taken over the same rows) a generative label model estimates each voter's accuracy (triplets of voters that are
independent given the label) and finds correlated voters, whose evidence is shared.  The
model's posterior labels train a sparse linear classifier on words and word
beginnings, calibrated on labelled rows that neither step has seen.

Defined cases: a null text is empty; an empty text gets the score of a text without known
words; without usable labels every score is the prior, 0 if there are no labels; a row whose labels
contradict each other counts with each; repeated rows are scored each; rows with a null id are scored, never learned from.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .ftrl import Ftrl, logits
from .jaccard import gram_sets, similarity_classes
from .language import is_held_out

SAMPLE = 16_000
VOTERS, VOCABULARY = 120, 6_000
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(p) for p in (r"!{3,}", r"\b[A-Z]{4,} [A-Z]{4,}\b", r"([A-Za-z])\1{3,}")]


def tokens_of(text: str) -> set[str]:
    """Distinct lower-cased words, and the beginnings of longer ones marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words.union(w[:n] + "*" for n in PREFIXES for w in words if len(w) > n)


def _patterns_in(text: str) -> list[int]:
    return [k for k, p in enumerate(_PATTERNS) if p.search(text)]


def _token_counts(batches):
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(tokens_of(text or ""))
    names = list(counts[1] | counts[0])
    yield pa.record_batch({
        "token": pa.array(names, pa.string()), "pos": pa.array([counts[1][t] for t in names], pa.int64()),
        "neg": pa.array([counts[0][t] for t in names], pa.int64())})


def mine(rows: DataFrame, n_pos: int, n_neg: int) -> tuple[list[str], list, list[str]]:
    """Voters, their rates by label, and the classifier's vocabulary, from ``(toxic, text)`` rows; both lists have a fixed size at most."""
    counts = rows.select("toxic", "text").mapInArrow(_token_counts, "token string, pos long, neg long").groupBy("token").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 4")
    lift = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    ranked = counts.withColumn("z", lift / error).withColumn("bound", lift - 2 * error).orderBy(F.desc(F.abs("z")), "token").limit(VOCABULARY).collect()
    voters: list[str] = []
    rates = []
    sure = [r for r in ranked if r["z"] > 3 and r["pos"] > 3 * r["neg"]]
    for r in sorted(sure, key=lambda r: (-round(r["bound"], 1), len(r["token"].rstrip("*")), r["token"])):
        nested = any(
            v.endswith("*") and r["token"].startswith(v[:-1]) or r["token"].endswith("*") and v.startswith(r["token"][:-1])
            for v in voters)
        if len(voters) < VOTERS and not nested:
            voters.append(r["token"])
            rates.append(((r["pos"] + 0.5) / (n_pos + 1), (r["neg"] + 0.5) / (n_neg + 1)))
    return voters, rates, sorted(r["token"] for r in ranked)


def _votes(text: str, voters: dict[str, int]) -> list[int]:
    found = tokens_of(text)
    return [voters[t] for t in found if t in voters] + [len(voters) + k for k in _patterns_in(text)]


def _ballots(voters: dict[str, int]):
    def run(batches):
        for batch in batches:
            votes = [sorted(_votes(t or "", voters)) for t in batch.column(1).to_pylist()]
            digests = np.frombuffer(b"".join(
                hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in gram_sets(batch.column(1), 5)), np.int64).reshape(-1, 2)
            yield pa.record_batch({
                "_id": batch.column(0), "set_a": pa.array(digests[:, 0]), "set_b": pa.array(digests[:, 1]),
                "votes": pa.array(votes, pa.list_(pa.int32()))})
    return run


def _moments(size: int):
    """Sums of votes that fall together; the cells -1, -2 and -3 hold the rows, those labelled toxic and those labelled clean."""
    def run(batches):
        sums, n = np.zeros((size, size), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            n += [batch.num_rows, *(int(np.sum(batch.column(k).to_numpy(zero_copy_only=False))) for k in (1, 2))]
            for votes in batch.column(0).to_pylist():
                if votes:
                    at = np.array(votes, np.int64)
                    sums[at[:, None], at[None, :]] += 1
        i, j = np.nonzero(sums)
        yield pa.record_batch({
            "i": pa.array([-1, -2, -3, *i.tolist()], pa.int64()), "j": pa.array([-1, -2, -3, *j.tolist()], pa.int64()),
            "n": pa.array([*n.tolist(), *sums[i, j].tolist()], pa.int64())})
    return run


class LabelModel:
    """Evidence of each voter, estimated from second moments and the share of the positive class.

    ``seen``: each voter's rate among positive and negative labelled rows, used for voters in fewer than three triplets.
    """

    def __init__(self, moments: np.ndarray, prior: float, seen: np.ndarray):
        size = len(moments)
        rate = np.diag(moments).copy()
        cov = moments - np.outer(rate, rate)
        scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
        # only voters that fire together say something about each other: those of two languages never do
        linked = cov / np.outer(scale, scale) > 0.02
        strength, few = np.zeros(size), np.ones(size, bool)
        for i in range(size):
            others = np.flatnonzero(linked[i])
            others = others[others != i]
            j, k = np.nonzero(np.triu(linked[np.ix_(others, others)], 1))
            if len(j) >= 3:
                j, k = others[j], others[k]
                strength[i], few[i] = np.sqrt(float(np.median(cov[i, j] * cov[i, k] / cov[j, k]))), False
            else:
                strength[i] = max(0.0, seen[i, 0] - seen[i, 1]) * np.sqrt(prior * (1 - prior))
        spread = prior * (1 - prior)
        toward = strength * np.sqrt(spread)
        self.given_toxic = np.clip(np.where(few, seen[:, 0], rate + toward / prior), 1e-4, 1 - 1e-4)
        self.given_clean = np.clip(np.where(few, seen[:, 1], rate - toward / (1 - prior)), 1e-5, self.given_toxic)
        # correlation that the common label does not explain
        rest = (cov - np.outer(strength, strength)) / np.outer(scale, scale)
        np.fill_diagonal(rest, 0)
        self.correlations = np.where(np.abs(rest) > 0.1, np.clip(rest, 0, 1), 0)
        share = 1 / (1 + self.correlations.sum(axis=1))
        # a voter that does not fire abstains: most are silent in all languages but one
        self.evidence = np.where(strength > 0, share * np.log(self.given_toxic / self.given_clean), 0)
        self.start = np.log(prior / (1 - prior))

    def posterior(self, votes: list[int]) -> float:
        at = np.array(votes, np.int64)
        return float(1 / (1 + np.exp(-np.clip(self.start + self.evidence[at].sum(), -30, 30))))


def _features(text: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(sorted(vocabulary[t] for t in tokens_of(text) if t in vocabulary), np.int64)
    return at, np.ones(len(at))


def _examples(voters: dict[str, int], vocabulary: dict[str, int], model: LabelModel):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch({
                "toxic": batch.column(0), "posterior": pa.array([model.posterior(_votes(t, voters)) for t in texts], pa.float64()),
                "at": pa.array([_features(t, vocabulary)[0].astype(np.int32).tobytes() for t in texts], pa.binary())})
    return run


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through scores, by Newton steps on slightly smoothed targets."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, 1 - 1 / (2 + y.sum()), 1 / (2 + (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-2 * (a - 1), (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def _score(weights: np.ndarray, vocabulary: dict[str, int], slope: float, offset: float):
    def run(batches):
        for batch in batches:
            scores = []
            for text in batch.column(1):
                z = logits(weights, *_features(text.as_py() or "", vocabulary))
                scores.append(1 / (1 + np.exp(-np.clip(slope * (z[1] - z[0]) + offset, -30, 30))))
            yield pa.record_batch({"id": batch.column(0), "score": pa.array(scores, pa.float64())})
    return run


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE,
    threshold: float = 0.3, epochs: int = 4,
) -> DataFrame:
    """``(id, held_out, score, predicted)``; held-out rows are those with a checksum of 2 modulo 4."""
    held = is_held_out(id, 4, 2)
    known = labels.select(F.col(id).alias("_id"), F.col(toxic).cast("int").alias("toxic")).where("toxic IN (0, 1)").distinct()
    source = docs.where(~held & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("text"))
    sizes = {r["toxic"]: r["n"] for r in source.select("_id").join(known, "_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    everyone = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    if not n_pos or not n_neg:
        flat = 1.0 if n_pos else 0.0
        return docs.select(F.col(id).cast("long").alias(id), held.alias("held_out"), F.lit(flat).alias("score"),
                           F.lit(int(flat >= threshold)).alias("predicted"))
    drawn = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    rate = min(1.0, sample / (n_pos + n_neg))
    # near copies would pass as many independent rows: of those in one class of the Jaccard join one counts
    id_type = source.schema["_id"].dataType.simpleString()
    apart = materialise(
        source.where(drawn < rate).join(known, "_id").groupBy("toxic", F.xxhash64("text").alias("row")).agg(
            F.min(F.struct("_id", "text")).alias("r")).select("toxic", "row", "r.*"), "apart")
    classes = similarity_classes(apart, "row").select("row", "class_id").distinct()
    labelled = apart.join(classes, "row").groupBy("toxic", "class_id").agg(F.min(F.struct("_id", "text")).alias("r")).select("toxic", "r.*")
    labelled = labelled.select("toxic", "text", (F.pmod(F.xxhash64(F.lit("tune"), "_id"), F.lit(4)) == 0).alias("tune"))
    labelled = materialise(labelled, "labelled")
    drawn_sizes = {r["toxic"]: r["n"] for r in labelled.where("NOT tune").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    voters, rates, vocabulary = mine(labelled.where("NOT tune"), drawn_sizes.get(1, 0), drawn_sizes.get(0, 0))
    voter_at = {t: k for k, t in enumerate(voters)}
    token_at = {t: k for k, t in enumerate(vocabulary)}

    size = len(voters) + len(_PATTERNS)
    ballots = source.select("_id", "text").mapInArrow(
        _ballots(voter_at), f"_id {id_type}, set_a long, set_b long, votes array<int>").join(known, "_id", "left")
    counts = ballots.groupBy("set_a", "set_b", "votes").agg(
        *[F.max((F.coalesce("toxic", F.lit(-1)) == k).cast("int")).alias(f"is{k}") for k in (1, 0)],
    ).select("votes", "is1", "is0").mapInArrow(_moments(size), "i long, j long, n long").groupBy("i", "j").agg(
        F.sum("n").alias("n")).collect()
    total, apart_pos, apart_neg = (sum(r["n"] for r in counts if r["i"] == k) for k in (-1, -2, -3))
    moments = np.zeros((size, size))
    for r in counts:
        if r["i"] >= 0:
            moments[r["i"], r["j"]] = r["n"] / max(total, 1)
    model = LabelModel(moments, apart_pos / (apart_pos + apart_neg), np.array(rates + [(0.0, 0.0)] * len(_PATTERNS)))

    rows = labelled.select(F.when(F.col("tune"), F.col("toxic")).alias("toxic"), "text").mapInArrow(
        _examples(voter_at, token_at, model), "toxic int, posterior double, at binary").collect()
    rows.sort(key=lambda r: (bytes(r["at"]), r["posterior"], -1 if r["toxic"] is None else r["toxic"]))
    features = [(a := np.frombuffer(r["at"], np.int32).astype(np.int64), np.ones(len(a))) for r in rows]
    train = [k for k, r in enumerate(rows) if r["toxic"] is None]
    tune = [k for k, r in enumerate(rows) if r["toxic"] is not None]
    soft = np.array([[1 - rows[k]["posterior"], rows[k]["posterior"]] for k in train]).reshape(-1, 2)
    weights = Ftrl(len(vocabulary), 2, alpha=0.2, l1=1.0, l2=0.1).fit([features[k] for k in train], soft, epochs)
    z = np.array([(v := logits(weights, *features[k]))[1] - v[0] for k in tune])
    y = np.array([rows[k]["toxic"] for k in tune], np.float64)
    slope, offset = _platt(z, y) if 0 < y.sum() < len(y) else (1.0, 0.0)
    found = everyone.mapInArrow(_score(weights, token_at, slope, offset), "id long, score double").withColumnRenamed("id", id)
    return found.select(id, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
