"""Sums over folds, keyword indexes and truncated components against plain definitions."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskgrain.operators import keyword_index
from riskgrain.operators.components import component_variance, principal_components
from riskgrain.operators.evaluate import evaluation, measures_of_counts
from riskgrain.operators.fold_stats import bernoulli_models, fold_counts, fold_measures, logistic_models
from riskgrain.operators.keywords import keyword_appearance, keyword_iv, presence_lists, presence_matrix, principal_variance, text_to_pairs
from riskgrain.operators.training import classifier, cross_validation, rank_features, with_score
from riskgrain.operators.sampling import stratified_folds


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        x = [float(rng.random() < p) for p in (0.5, 0.3, 0.6, 0.1)]
        rows.append((k, *x, int(rng.random() < 0.15 + 0.5 * x[0] + 0.2 * x[1])))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")
    return df.withColumn("features", array_to_vector(F.array("a", "b", "c", "d")))


# folds

def fold_by_fold(study, estimator, n_fold, n_round):
    """The general path: a fit for every fold."""
    found = []
    for r in range(n_round):
        folded = stratified_folds(study.select("id", "features", "y"), "id", "y", n_fold, 7 + r).cache()
        for f in range(n_fold):
            model = estimator.fit(folded.where(F.col("fold") != f))
            sides = []
            for part in (F.col("fold") != f, F.col("fold") == f):
                m = evaluation(with_score(model.transform(folded.where(part))).select("y", F.round("score", 9).alias("score")), "y", "score", n_bin=50).first()
                sides.append((m["auc"], m["ks"]))
            found.append((r, f, sides[0][0], sides[1][0], sides[0][1], sides[1][1]))
    return found


@pytest.mark.parametrize("name", ["bnb", "lr"])
def test_cross_validation_by_sums(study, name):
    found = [tuple(r) for r in cross_validation(study, "id", "y", classifier(name, "y"), 4, 2).collect()]
    want = fold_by_fold(study, classifier(name, "y"), 4, 2)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2:4] for f in found], [w[2:4] for w in want], atol=1e-9), (found, want)
    assert np.allclose([f[4:] for f in found], [w[4:] for w in want], atol=1e-9)


def test_logistic_weights(study):
    """Newton's weights of a subset are those of a fit on the training rows."""
    counts = fold_counts(study, "id", "y", "features", 3, 1)
    models = {(m.subset, m.fold): m for m in logistic_models(counts, [[0, 1, 2, 3], [1, 3]])}
    folded = stratified_folds(study.select("id", "a", "b", "c", "d", "y"), "id", "y", 3, 7)
    for fold in range(3):
        train = folded.where(F.col("fold") != fold)
        whole = LogisticRegression(labelCol="y", tol=1e-12, maxIter=500).fit(train.select("y", array_to_vector(F.array("a", "b", "c", "d")).alias("features")))
        part = LogisticRegression(labelCol="y", tol=1e-12, maxIter=500).fit(train.select("y", array_to_vector(F.array("b", "d")).alias("features")))
        m = models[0, fold]
        assert np.allclose([m.intercept, *m.weights], [whole.intercept, *whole.coefficients], atol=1e-4)
        m = models[1, fold]
        assert np.allclose([m.intercept, m.weights[1], m.weights[3]], [part.intercept, *part.coefficients], atol=1e-4) and m.weights[0] == m.weights[2] == 0


def test_blocks_of_models_change_nothing(study, monkeypatch):
    from riskgrain.operators import fold_stats

    counts = fold_counts(study, "id", "y", "features", 3, 2)
    whole = logistic_models(counts, [[0, 1], [2, 3]])
    monkeypatch.setattr(fold_stats, "CELLS", 60)
    again = logistic_models(counts, [[0, 1], [2, 3]])
    assert all(a.weights == pytest.approx(b.weights, abs=1e-9) for a, b in zip(whole, again)) and len(whole) == 12
    assert bernoulli_models(counts, [[0]])[0].weights[1:] == (0.0, 0.0, 0.0)
    assert fold_measures(counts, whole, 20).count() == 24


def test_separable_folds_stay_finite(spark):
    rows = [(k, [float(k % 2), float(k % 3)], k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, features array<double>, y int")
    models = logistic_models(fold_counts(df, "id", "y", "features", 3, 1), [[0, 1]])
    assert all(np.isfinite(m.weights).all() for m in models)
    found = cross_validation(df.withColumn("features", array_to_vector("features")), "id", "y", classifier("lr", "y"), 3, 1).collect()
    assert all(r["auc_test"] == 1.0 for r in found)


def test_counted_measures(spark):
    rng = random.Random(1)
    rows = [(str(rng.randrange(3)), rng.randrange(9) / 8, rng.randrange(4), rng.randrange(4)) for _ in range(200)]
    counts = spark.createDataFrame(rows, "subset string, score double, p long, n long")
    plain = counts.select("subset", "score", F.explode(F.concat(F.array_repeat(F.lit(1), F.col("p").cast("int")), F.array_repeat(F.lit(0), F.col("n").cast("int")))).alias("y"))
    assert sorted(map(tuple, measures_of_counts(counts, 10).collect())) == sorted(map(tuple, evaluation(plain, "y", "score", by="subset", n_bin=10).collect()))


def test_elimination_by_sums(study):
    """The same steps as fits of all candidates one by one."""
    columns = ["a", "b", "c", "d"]
    for name, params in (("lr", {}), ("bnb", {})):
        found = [tuple(r) for r in rank_features(study.select("id", "y", *columns), "id", "y", columns, name=name, n_fold=3, n_round=1).collect()]
        assert [f[0] for f in found] == [4, 3, 2, 1] and sorted(f[3] for f in found) == columns and found[-1][3] == "a"
    general = [tuple(r) for r in rank_features(study.select("id", "y", *columns), "id", "y", columns, name="lr", n_fold=3, n_round=1, tol=1e-9).collect()]
    found = [tuple(r) for r in rank_features(study.select("id", "y", *columns), "id", "y", columns, name="lr", n_fold=3, n_round=1).collect()]
    assert [g[3] for g in general] == [f[3] for f in found]
    assert np.allclose([g[1:3] for g in general], [f[1:3] for f in found], atol=1e-3)


# keywords

TEXTS = ["", None, "a", "ab", "the cat sat on the mat", "Größe über alles, naïve café ☕ \U0001f600 ende", "aaaaaaa", "ẞßé", "mat\x00cat"]
WORDS = ["", "a", "ab", "cat", "the cat", "mat", "ö", "ß", "é", "café ☕", "\U0001f600", "aaa", "aaaaaaaa", "nowhere", "at", "e", " ", "\x00", "aaa", "ende"]


def test_index_finds_what_contains_finds():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abé ") for _ in range(rng.randrange(60))) for _ in range(200)]
    words = WORDS + ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    for counts in (None, np.random.default_rng(1).integers(0, 9, keyword_index.CELLS)):
        row, word = keyword_index.WordIndex.of(words, counts).found(pa.array(texts))
        want = [(r, w) for r, t in enumerate(texts) if t is not None for w, x in enumerate(words) if x in t]
        assert list(zip(row.tolist(), word.tolist())) == want


def test_index_in_small_pieces(monkeypatch):
    texts = ["the cat and the hat " * k for k in range(40)] + [None] * 3
    words = ["cat", "hat the", "t", "he", "zz", "and the hat the cat and"]
    whole = keyword_index.WordIndex.of(words).found(pa.array(texts)[2:])
    monkeypatch.setattr(keyword_index, "CHUNK", 64)
    monkeypatch.setattr(keyword_index, "COMPARED", 10)
    again = keyword_index.WordIndex.of(words).found(pa.array(texts)[2:])
    assert all((a == b).all() for a, b in zip(whole, again)) and len(whole[0]) > 100


def test_many_words_like_few(spark, sf_documents):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(1, 5))) for _ in range(600)})
    assert len(words) > 300
    pairs = {tuple(r) for r in text_to_pairs(sf_documents, "text", words, ["doc_id"]).collect()}
    plain = {(r["doc_id"], w) for r in sf_documents.select("doc_id", "text").collect() if r["text"] is not None for w in words if w in r["text"]}
    assert pairs == plain
    few = words[:60]
    many = few + [f"#{k}#" for k in range(100)]
    docs = sf_documents.withColumn("y", (F.col("lang") == "fr").cast("int"))
    a, b = ([tuple(r)[1:] for r in keyword_iv(docs, w, "y", text="text").collect()] for w in (few, many))
    assert [x[0] for x in b[:60]] == few and all(x[1] == pytest.approx(y[1], abs=1e-12) for x, y in zip(a, b))
    wide = presence_matrix(docs, "doc_id", "text", few, label="y").join(docs.select("doc_id", "text", "source"), "doc_id")
    one = [tuple(r) for r in keyword_appearance(wide, ["text", "source"], few, "y").collect()]
    two = [tuple(r) for r in keyword_appearance(docs, ["text", "source"], few, "y", text="text").collect()]
    assert one == two
    lists = {r["doc_id"]: r["present"] for r in presence_lists(docs, "doc_id", "text", few).collect()}
    assert lists == {r["doc_id"]: [k for k, w in enumerate(few) if r[w]] for r in wide.collect()}


def test_five_thousand_words_cost_little(spark, sf_documents):
    """The index against the search of each word, on the same rows."""
    words = [f"{a}{b}{c}" for a in "abcdefghilmnoprst" for b in "abcdefghilmnoprst" for c in "abcdefghilmnoprst"]
    docs = sf_documents.repartition(8).cache()
    docs.count()

    def seconds(run):
        started = time.perf_counter()
        return run(), time.perf_counter() - started

    fast, quick = seconds(lambda: text_to_pairs(docs, "text", words, ["doc_id"]).count())
    slow, long = seconds(lambda: docs.select("doc_id", F.explode(F.filter(F.lit(words), lambda w: F.contains(F.col("text"), w)))).count())
    print(f"4,913 words: index {quick:.1f} s, loop {long:.1f} s")
    assert fast == slow


@pytest.fixture(scope="module")
def sf_documents(spark):
    import os

    return spark.read.parquet(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/documents.parquet")


# components

def test_truncated_components_of_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.stack(table.select("embedding").toPandas()["embedding"].to_numpy()).astype(float)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    found, directions, total = principal_components(table, "embedding", 20)
    assert np.allclose(found, values[:20], rtol=1e-6) and total == pytest.approx(values.sum(), rel=1e-9)
    assert np.allclose(directions.T @ directions, np.eye(20), atol=1e-8)
    full = [r["variance_ratio"] for r in principal_variance(table, "embedding", 20).collect()]
    assert [r["variance_ratio"] for r in component_variance(table, "embedding", 20).collect()] == pytest.approx(full, abs=1e-6)


def test_truncated_components_of_sparse_rows(spark):
    """50,000 columns, of which a few carry nearly all variance."""
    rng = random.Random(6)
    rows = [(k, sorted({*(rng.sample(range(20), 8) if k % 2 else range(20, 28)), *rng.sample(range(50_000), 5)})) for k in range(600)]
    table = spark.createDataFrame([*rows, (-1, None)], "id long, x array<int>")
    found, directions, total = principal_components(table, "x", 3, width=50_000, sparse=True, passes=6)
    used = sorted({c for _, r in rows for c in r})
    dense = np.zeros((600, len(used)))
    for k, r in rows:
        dense[k, np.searchsorted(used, r)] = 1
    centred = dense - dense.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2 / 599
    assert found[0] == pytest.approx(values[0], rel=1e-6) and np.allclose(found, values[:3], rtol=1e-3)
    assert total == pytest.approx(values.sum(), rel=1e-9) and directions.shape == (50_000, 3)


def test_components_of_degenerate_tables(spark):
    empty = spark.createDataFrame([], "x array<double>")
    assert component_variance(empty, "x", 3).count() == 0
    one = spark.createDataFrame([([1.0, 2.0],)] * 4, "x array<double>")
    assert [r["variance_ratio"] for r in component_variance(one, "x", 3).collect()] == [None, None]
    flat = spark.createDataFrame([([float(k), 2.0 * k, None],) for k in range(5)], "x array<double>")
    assert [r["variance_ratio"] for r in component_variance(flat, "x", 3).collect()] == pytest.approx([1.0, 0.0, 0.0], abs=1e-9)


def test_memory_of_the_index_follows_the_chunk():
    """Nearly every place of the texts holds a word: what is found is reduced chunk by chunk, also within a long text."""
    words = [a + b for a in "abcd" for b in "abcd"]
    rng = random.Random(3)
    part = "".join(rng.choices("abcd", k=10_000))
    texts = pa.array([part[:500]] * 6_000 + [part * 300, "é" * 5 + "ab"])
    index = keyword_index.WordIndex.of(words)
    tracemalloc.start()
    row, word = index.found(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    assert (row == 6_000).sum() == 16 and word[row == 6_001].tolist() == [1]
    assert [words[w] for w in word[row == 0]] == [w for w in words if w in part[:500]]


def test_appearance_counts_words_in_text_and_fields(spark):
    rows = [("ab cd", "ab", 1), ("ab", None, 0), (None, "ab", 1), ("cd", "ab cd", None), ("", "", 1)]
    df = spark.createDataFrame(rows, "body string, f string, label int")
    words = ["ab", "cd", "zz", "ab"] + [f"w{k}" for k in range(200)]
    got = [tuple(r) for r in keyword_appearance(df, ["body", "f"], words, text="body").collect()][:4]
    assert got == [(0, "ab", 0.5, 2 / 3, 2, 1), (1, "cd", 0.5, 2 / 3, 2, 1), (2, "zz", None, 0.6, 0, 0), (3, "ab", 0.5, 2 / 3, 2, 1)]
