"""Training jobs on Spark ML: single fits, repeated runs, cross-validation, feature ranking."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import literal, materialise, scratch_path
from ..sources.runs import append_run, clock, save_model, save_results
from .adaboost import AdaBoost
from .boosting import REWRITE, Booster, BoostedTrees
from .evaluate import auc, evaluation, metric_summary
from .fold_stats import MODELS, fold_counts, fold_measures
from .sampling import stratified_folds, stratified_split

FEATURES = "features"
CV_KS_BINS = 50
#: Measures of two rounds that agree to so many digits are equal.
CURVE_DIGITS = 12

# gbc follows first-order gradients, xgboost gradients and hessians; the support
# vector machine is linear and is scored by its margin.
CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "lr": LogisticRegression,
    "rf": RandomForestClassifier,
    "gbc": GBTClassifier,
    "adaboost": AdaBoost,
    "xgboost": BoostedTrees,
    "bnb": lambda **p: NaiveBayes(modelType="bernoulli", **p),
    "svm": LinearSVC,
}


def classifier(name: str, label: str = "label", features: str = FEATURES, **params) -> Estimator:
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; choose from {sorted(CLASSIFIERS)}")
    return CLASSIFIERS[name](labelCol=label, featuresCol=features, **params)


def prepare_vars(
    df: DataFrame, numerical: Sequence[str], categorical: Sequence[str] = (), scale: bool = True, out: str = FEATURES
) -> tuple[DataFrame, PipelineModel]:
    """Encode inputs: numbers scaled to unit variance and zero mean, categories one-hot."""
    stages, inputs = [], []
    if numerical:
        stages.append(VectorAssembler(inputCols=list(numerical), outputCol="_num", handleInvalid="error"))
        inputs.append("_num")
        if scale:
            stages.append(StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True))
            inputs[-1] = "_scaled"
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_idx_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"_idx_{c}"], outputCols=[f"_hot_{c}"], dropLast=False))
        inputs.append(f"_hot_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out))
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df), model


def with_score(df: DataFrame, out: str = "score") -> DataFrame:
    """The score of the positive class: its probability, or the raw margin."""
    source = "probability" if "probability" in df.columns else "rawPrediction"
    return df.withColumn(out, vector_to_array(F.col(source))[1])


def class_probabilities(model: Model, df: DataFrame) -> DataFrame:
    """Probabilities of both classes."""
    p = vector_to_array(F.col("probability"))
    return model.transform(df).withColumns({"p0": p[0], "p1": p[1]})


def importances(model: Model, names: Sequence[str]) -> DataFrame:
    """Gain, cover and weight per feature of a tree ensemble.

    Weight counts the splits, gain and cover are means over them.  Second-order
    models hold their splits, cover being the hessian; those of Spark's own
    ensembles come from the stored node table, cover being the rows.
    """
    spark = SparkSession.active()
    if hasattr(model, "split_table"):
        splits = literal(spark, [s[1:] for s in model.split_table()], "i int, gain double, cover double")
    else:
        path = scratch_path(spark, "trees")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").where("leftChild >= 0")
        splits = nodes.select(F.col("split.featureIndex").alias("i"), "gain", F.col("rawCount").alias("cover"))
    used = splits.groupBy("i").agg(F.avg("gain").alias("gain"), F.avg("cover").alias("cover"), F.count("*").alias("weight"))
    listed = literal(spark, list(enumerate(names)), "i int, feature string")
    zero = F.lit(0.0)
    return listed.join(used, "i", "left").select(
        "feature", F.coalesce("gain", zero).alias("gain"), F.coalesce("cover", zero).alias("cover"),
        F.coalesce("weight", F.lit(0)).alias("weight"),
    )


def fit_and_score(
    train: DataFrame, rows: DataFrame, label: str, name: str = "lr", keep: Sequence[str] = (), **params
) -> tuple[Model, DataFrame]:
    """Fit on ``train`` and score ``rows``: kept columns, label, score and prediction."""
    model = classifier(name, label, **params).fit(train)
    scored = with_score(model.transform(rows)).select(*keep, label, "score", F.col("prediction").cast("int"))
    return model, scored


def run_model(
    df: DataFrame, key: str, label: str, name: str, n_run: int, sizes: dict[str, int], seed: int = 7, **params
) -> tuple[DataFrame, Model]:
    """Repeat a fit on fresh training and validation samples against one fixed test sample.

    Returns one row per run and split with AUC, KS and accuracy, and the model of
    the run with the best test AUC.
    """
    spark = df.sparkSession
    negative_rate = df.agg(F.avg((F.col(label) == 0).cast("double"))).first()[0]
    drawn = stratified_split(df, key, label, {"test": sizes["test"]}, seed)
    drawn = materialise(drawn, "test-drawn")
    test, pool = drawn.where("split = 'test'"), drawn.where("split is null").drop("split")
    rest = {s: sizes[s] for s in ("train", "val")}
    results, best = [], (None, -1.0)
    for run in range(n_run):
        split = stratified_split(pool, key, label, rest, seed + run + 1, negative_rate=negative_rate)
        rows = split.where("split is not null").unionByName(test)
        started = time.time()
        model = classifier(name, label, **params).fit(rows.where("split = 'train'"))
        seconds = time.time() - started
        scored = with_score(model.transform(rows)).select("split", label, "score", F.col("prediction").cast("int"))
        scored = materialise(scored, "scored")
        measured = evaluation(scored, label, "score", "prediction", by="split").collect()
        for r in measured:
            results.append((run, r["split"], r["auc"], r["ks"], r["acc"], seconds))
            if r["split"] == "test" and (r["auc"] or 0.0) > best[1]:
                best = (model, r["auc"] or 0.0)
    table = literal(
        spark, results, "run int, split string, auc double, ks double, acc double, fit_seconds double"
    )
    return table, best[0]


def logged_run(
    df: DataFrame, key: str, label: str, name: str, n_run: int, sizes: dict[str, int], folder: str, seed: int = 7,
    remark: str | None = None, **params,
) -> str:
    """``run_model`` with everything it finds stored below ``folder``; returns the run's id.

    ``results`` gets the measures as a new version, ``models/<id>`` the best
    model, ``params/<id>`` the classifier's parameters as JSON, and ``log`` one
    line with the mean measures per split and the mean fitting time.
    """
    spark = df.sparkSession
    results, model = run_model(df, key, label, name, n_run, sizes, seed, **params)
    run_id = save_results(results, f"{folder}/results", name)
    save_model(model, f"{folder}/models/{run_id}")
    literal(spark, [(json.dumps(params, sort_keys=True),)], "value string").write.text(f"{folder}/params/{run_id}")
    measures = ("auc", "ks", "acc")
    means = results.groupBy("split").agg(*[F.avg(m).alias(m) for m in measures], F.avg("fit_seconds").alias("seconds")).collect()
    append_run(
        spark, f"{folder}/log", train_size=sizes["train"], classifier=run_id, time_spent=clock(means[0]["seconds"]),
        result_path=f"{folder}/results/run_id={run_id}", params_path=f"{folder}/params/{run_id}", remark=remark,
        **{f"{m}_{r['split']}": r[m] for r in means for m in measures},
    )
    return run_id


def _in_parallel(jobs: Sequence[Callable], parallelism: int) -> list:
    """Run driver-side jobs side by side; each is a sequence of Spark jobs."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    pool = ThreadPool(min(parallelism, len(jobs)))
    try:
        return pool.map(lambda run: run(), [inheritable_thread_target(SparkSession.active())(j) for j in jobs])
    finally:
        pool.close()


def _fold_scores(
    folded: DataFrame, key: str, label: str, features: str, estimator: Estimator, fold: int, name: str,
    resampler: Callable[[DataFrame, str, str, str], DataFrame] | None = None,
) -> DataFrame:
    """Fit on all folds but one and score both sides, as rows ``(part, label, score)``."""
    train = folded.where(F.col("fold") != fold).select(key, features, label)
    test = folded.where(F.col("fold") == fold).select(key, features, label)
    if resampler is not None:
        arrays = train.withColumn(features, vector_to_array(F.col(features)))
        train = materialise(resampler(arrays, key, features, label), "resampled").withColumn(
            features, array_to_vector(F.col(features))
        )
    model = estimator.copy({estimator.featuresCol: features}).fit(train)
    sides = [
        with_score(model.transform(rows)).select(F.lit(f"{name}:{fold}:{side}").alias("part"), label, "score")
        for side, rows in (("train", train), ("test", test))
    ]
    return sides[0].unionByName(sides[1])


def _measured(parts: Sequence[DataFrame], label: str) -> dict[str, dict[int, dict[str, tuple[float, float]]]]:
    """AUC and KS of scored parts as name -> fold -> side, from one evaluation."""
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    found: dict = {}
    for m in evaluation(materialise(joined, "scored"), label, "score", by="part", n_bin=CV_KS_BINS).collect():
        name, fold, side = m["part"].rsplit(":", 2)
        found.setdefault(name, {}).setdefault(int(fold), {})[side] = (m["auc"], m["ks"])
    return found


def cross_validation(
    df: DataFrame,
    key: str,
    label: str,
    estimator: Estimator,
    n_fold: int = 10,
    n_round: int = 10,
    resampler: Callable[[DataFrame, str, str, str], DataFrame] | None = None,
    seed: int = 7,
    parallelism: int = 4,
) -> DataFrame:
    """Repeated stratified cross-validation: one row per round and fold.

    ``df`` has the feature vector in the estimator's features column.  A
    resampler takes and returns rows of ``(key, array, label)`` and sees the
    training part only; training measures are taken on what it returns.

    Without a resampler, plain Bernoulli naive Bayes and plain logistic
    regression are fitted from sums over the folds, all rounds and folds together.
    """
    features = estimator.getFeaturesCol()
    schema = "round int, fold int, auc_train double, auc_test double, ks_train double, ks_test double"
    if resampler is None and (name := _additive(estimator)):
        counts = fold_counts(df, key, label, features, n_fold, n_round, seed)
        found = fold_measures(counts, MODELS[name](counts, [range(counts.width)]), CV_KS_BINS)
        sides = [F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{m}_{side}") for m in ("auc", "ks") for side in ("train", "test")]
        return literal(df.sparkSession, found.groupBy("round", "fold").agg(*sides).orderBy("round", "fold").collect(), schema)
    rows = []
    for r in range(n_round):
        folded = materialise(
            stratified_folds(df.select(key, features, label), key, label, n_fold, seed + r), "folds"
        )
        jobs = [
            partial(_fold_scores, folded, key, label, features, estimator, f, str(r), resampler) for f in range(n_fold)
        ]
        for f, m in sorted(_measured(_in_parallel(jobs, parallelism), label)[str(r)].items()):
            rows.append((r, f, m["train"][0], m["test"][0], m["train"][1], m["test"][1]))
    return literal(df.sparkSession, rows, schema)


def _additive(estimator: Estimator) -> str | None:
    """The name of a classifier that sums over the folds determine, if the estimator is set up as they take it."""
    given = {p.name for p in estimator.extractParamMap() if estimator.isSet(p)} - {"featuresCol", "labelCol"}
    if isinstance(estimator, NaiveBayes) and given <= {"modelType"} and estimator.getModelType() == "bernoulli":
        return "bnb"
    return "lr" if isinstance(estimator, LogisticRegression) and not given else None


def cv_summary(results: DataFrame) -> DataFrame:
    """Mean and population standard deviation over all rounds and folds."""
    return metric_summary(results, ["auc_train", "auc_test", "ks_train", "ks_test"])


def boosting_rounds(
    df: DataFrame, key: str, label: str, n_fold: int = 3, max_rounds: int = 20, early_stop: int = 5, seed: int = 7,
    **params,
) -> DataFrame:
    """Cross-validated second-order boosting with early stopping: mean train and test AUC per round.

    Rounds end when the mean test AUC has not improved for ``early_stop`` rounds;
    the last row is the stopping point.  The folds' models grow side by side in
    the same jobs, a few rounds at a time (``trained`` tells how many in all), and
    go on from where they are until the curve stops.
    """
    folded = materialise(stratified_folds(df.select(key, FEATURES, label), key, label, n_fold, seed), "folds")
    booster = Booster(folded, label, FEATURES, n_fold, "fold", **BoostedTrees(**params).booster_options())
    kept, best, since, done = [], -1.0, 0, 0
    while done < max_rounds and since < early_stop:
        more = min(REWRITE, max_rounds - done)
        booster.grow(more)
        for row in _boosting_curve(booster.curve(done, done + more)):
            kept.append(tuple(row))
            best, since = (row["auc_test"], 0) if row["auc_test"] > best else (best, since + 1)
            if since >= early_stop:
                break
        done += more
    return literal(df.sparkSession, [(*k, done) for k in kept], "rounds int, auc_train double, auc_test double, trained int")


def _boosting_curve(scores: DataFrame) -> list:
    """Mean train and test AUC of the models after each round."""
    named = scores.select(F.concat_ws(":", "m", "test", "rounds").alias("subset"), "y", "score")
    bits = F.split("subset", ":")
    return (
        auc(materialise(named, "rounds"), "y", "score", by="subset")
        .select(bits[1].alias("test"), bits[2].cast("int").alias("rounds"), F.round("auc", CURVE_DIGITS).alias("auc"))
        .groupBy("rounds").pivot("test", ["false", "true"]).agg(F.round(F.avg("auc"), CURVE_DIGITS).alias("auc"))
        .select("rounds", F.col("false").alias("auc_train"), F.col("true").alias("auc_test"))
        .orderBy("rounds").collect()
    )


def rank_features(
    df: DataFrame, key: str, label: str, numerical: Sequence[str], categorical: Sequence[str] = (),
    name: str = "lr", n_fold: int = 10, n_round: int = 10, seed: int = 7, parallelism: int = 4, **params,
) -> DataFrame:
    """Backward elimination: drop the feature whose removal keeps the best test AUC, until one is left.

    One row per step: features left, mean AUCs, and the feature removed next (the
    last row names the survivor).  Every feature is encoded once and every
    round's folds are drawn once; a step fits all its candidates on them and
    evaluates them together.  Naive Bayes and logistic regression without
    parameters are fitted from sums over the folds; naive Bayes takes numbers as
    they are, 0 or 1.
    """
    encoded = {f: f"_enc_{i}" for i, f in enumerate([*numerical, *categorical])}
    rows = df
    for f, out in encoded.items():
        numbers, names = ([f], []) if f in numerical else ([], [f])
        rows, _ = prepare_vars(rows, numbers, names, scale=name != "bnb", out=out)
        rows = rows.select(*df.columns, *[c for c in rows.columns if c.startswith("_enc_")])
    rows = materialise(rows.select(key, label, *encoded.values()), "encoded")
    if name in MODELS and not params:
        return _eliminated(df.sparkSession, list(encoded), _summed_trials(rows, key, label, encoded, name, n_fold, n_round, seed))
    rounds = [
        materialise(stratified_folds(rows, key, label, n_fold, seed + r), "folds") for r in range(n_round)
    ]
    estimator = classifier(name, label, **params)

    def measure(candidates: dict[str, Sequence[str]]) -> dict[str, tuple[float, float]]:
        jobs = []
        for c, names in candidates.items():
            assembler = VectorAssembler(inputCols=[encoded[f] for f in names], outputCol=FEATURES)
            for r, folded in enumerate(rounds):
                assembled = assembler.transform(folded)
                jobs += [
                    partial(_fold_scores, assembled, key, label, FEATURES, estimator, f, f"{c}:{r}")
                    for f in range(n_fold)
                ]
        found: dict[str, list] = {}
        for part, folds in _measured(_in_parallel(jobs, parallelism), label).items():
            found.setdefault(part.rsplit(":", 1)[0], []).extend(folds.values())
        return {
            c: tuple(sum(m[side][0] for m in ms) / len(ms) for side in ("train", "test")) for c, ms in found.items()
        }

    return _eliminated(df.sparkSession, list(encoded), measure)


def _eliminated(spark: SparkSession, pool: list[str], measure: Callable[[dict], dict[str, tuple[float, float]]]) -> DataFrame:
    """The steps; ``measure`` gives mean train and test AUC of named feature lists."""
    steps = [(len(pool), *measure({"all": pool})["all"])]
    removed = []
    while len(pool) > 1:
        trials = measure({f: [p for p in pool if p != f] for f in pool})
        dropped = max(pool, key=lambda f: round(trials[f][1], CURVE_DIGITS))
        pool = [p for p in pool if p != dropped]
        steps.append((len(pool), *trials[dropped]))
        removed.append(dropped)
    removed.append(pool[0])
    return literal(
        spark, [(*s, r) for s, r in zip(steps, removed)],
        "num_var int, auc_train double, auc_test double, removed string",
    )


def _summed_trials(
    rows: DataFrame, key: str, label: str, encoded: dict[str, str], name: str, n_fold: int, n_round: int, seed: int,
) -> Callable[[dict], dict[str, tuple[float, float]]]:
    """``measure`` from sums over the folds: a step's candidates are subsets of the columns of one table of counts."""
    sizes = rows.select(*[F.size(vector_to_array(c)).alias(c) for c in encoded.values()]).first()
    ends = [sum((sizes or [1] * len(encoded))[:k]) for k in range(len(encoded) + 1)]
    columns = {f: range(a, b) for f, a, b in zip(encoded, ends, ends[1:])}
    assembled = VectorAssembler(inputCols=list(encoded.values()), outputCol=FEATURES).transform(rows)
    counts = fold_counts(assembled, key, label, FEATURES, n_fold, n_round, seed)

    def measure(candidates: dict[str, Sequence[str]]) -> dict[str, tuple[float, float]]:
        names = list(candidates)
        models = MODELS[name](counts, [[i for f in candidates[c] for i in columns[f]] for c in names])
        found = fold_measures(counts, models, CV_KS_BINS).groupBy("subset").pivot("side", ["train", "test"]).agg(F.avg("auc"))
        return {names[r["subset"]]: (r["train"], r["test"]) for r in found.collect()}

    return measure
