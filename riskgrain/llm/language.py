"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character one- to three-grams of the lower-cased text, with every other character than
a letter as a space, are hashed into ``FEATURES`` counts.  Document frequencies come
from all learnable rows; the regression is trained by follow-the-regularised-leader with
elastic-net penalties on a bounded sample (``sample`` rows, as many of each language) and calibrated by
a temperature on a fifth of it.

Defined cases: a null text, or one without a letter, is ``und`` with a score of 0, as is every
text if nothing can be learned from; rows without a language or an id are predicted but not
learned from; equal probabilities go to the first language in order; repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ftrl import Ftrl, logits, softmax, temperature
from .line_dedup import fresh

FEATURES = 1 << 13
SAMPLE = 4000
CHUNK_CHARS = 1 << 20
#: Rows whose texts are Python strings at the same time.
ROWS = 512
_SHIFT = np.uint32(32 - 13)


def _letters() -> np.ndarray:
    """For the characters of the first plane, themselves if letters, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


def gram_counts(texts: list[str], letters: np.ndarray):
    """Hashed n-grams of each text: their numbers and how often they occur."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK_CHARS):
            size += len(texts[stop])
            stop += 1
        lowered = [t.lower() for t in texts[start:stop]]
        c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 1 << 16, letters[np.minimum(c, (1 << 16) - 1)], c)
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:]
        three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:]
        grams = [((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> _SHIFT for g in (one, two, three)]
        ends = np.cumsum([0, *map(len, lowered)])
        for a, b in zip(ends[:-1], ends[1:]):
            counts = np.bincount(np.concatenate([g[a:max(a, b - k)] for k, g in enumerate(grams)]), minlength=FEATURES)
            at = np.flatnonzero(counts)
            yield at, counts[at]
        start = stop


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, at: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = softmax(logits(self.weights, at, self.vector(at, counts)) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def _frequencies(batches):
    letters, df, n = _letters(), np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for at, _ in gram_counts([t or "" for t in batch.column(0).to_pylist()], letters):
            df[at] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.record_batch({"feature": pa.array([-1, *at.tolist()], pa.int64()), "n": pa.array([n, *df[at].tolist()], pa.int64())})


def _vectors(batches):
    letters = _letters()
    for batch in batches:
        found = list(gram_counts([t or "" for t in batch.column(1).to_pylist()], letters))
        yield pa.record_batch({
            "label": batch.column(0), "at": pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()),
            "counts": pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())})


def fit(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, epochs: int = 3,
) -> Model:
    """Model of the rows with an id, a text and a language."""
    rows = docs.where(F.col(id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    total = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy(
        "feature").agg(F.sum("n").alias("n")).collect()}
    df = np.array([total.get(k, 0) for k in range(FEATURES)], np.float64)
    idf = np.log((1 + total[-1]) / (1 + df)) + 1

    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for label in labels:
        rate = F.when(F.col("label") == label, sample / len(labels) / sizes[label]).otherwise(rate)
    found = rows.where(drawn < rate).select("label", "text").limit(2 * sample).mapInArrow(
        _vectors, "label string, at binary, counts binary").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["counts"])))
    model = Model(labels, idf, np.zeros((FEATURES + 1, len(labels))), 1.0)
    pairs = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in found]
    x = [(at, model.vector(at, c)) for at, c in pairs]
    y = np.array([labels.index(r["label"]) for r in found], np.int64)
    held = np.arange(len(x)) % 5 == 0
    one_hot = np.eye(len(labels))[y] if len(y) else np.zeros((0, len(labels)))
    train = [v for v, h in zip(x, held) if not h]
    model.weights = Ftrl(FEATURES, len(labels)).fit(train, one_hot[~held], epochs)
    scores = np.array([logits(model.weights, at, v) for (at, v), h in zip(x, held) if h])
    model.temperature = temperature(scores, y[held]) if held.any() else 1.0
    return model


def _predict(model: Model):
    def run(batches):
        letters = _letters()
        for batch in batches:
            langs, scores = [], []
            for known, (at, counts) in zip(batch.column(1).to_pylist(), gram_counts(
                    [t or "" for t in batch.column(2).to_pylist()], letters)):
                lang, score = model.predict(at, counts) if known and model.labels else ("und", 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.record_batch({
                "id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})
    return run


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, lang_pred, score)``, one row per row."""
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id).cast("long").alias("id"), has_letter.alias("known"), F.col(text).alias("text")).mapInArrow(
        _predict(model), "id long, lang_pred string, score double").withColumnRenamed("id", id)


def is_held_out(id: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """Whether the checksum of the id as text falls into the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` by a model of the rows that are not held out."""
    model = fit(docs.where(~is_held_out(id)), id, text, lang, **options)
    return predict(docs, model, id, text).select(id, is_held_out(id).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.35, **options) -> DataFrame:
    """The documents whose language is found with a score of ``least`` or more; a missing language is filled in."""
    model = fit(docs.where(~is_held_out(id)), id, text, lang, **options)
    rest = [c for c in docs.columns if c != lang]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "_known")[0])

    def run(batches):
        letters = _letters()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [
                model.predict(*g) if k and model.labels else ("und", 0.0)
                for k, g in zip(batch.column(batch.num_columns - 1).to_pylist(), gram_counts([t or "" for t in texts], letters))]
            keep = pa.array([name != "und" and score >= least for name, score in found], pa.bool_())
            given = batch.column(batch.schema.get_field_index(lang)).to_pylist()
            filled = pa.array([g if g is not None else name for g, (name, _) in zip(given, found)], pa.string())
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in rest} | {lang: filled}
            yield pa.record_batch({c: columns[c] for c in docs_columns}).filter(keep)

    docs_columns = docs.columns
    return docs.select("*", known).mapInArrow(run, schema)
