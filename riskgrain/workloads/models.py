"""Training queries: keyword presence as features, the French documents as the class to find."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import flag
from ..operators.evaluate import evaluation
from ..operators.keywords import presence_matrix
from ..operators.resample import Resampler
from ..operators.sampling import random_split
from ..operators.training import (
    boosting_rounds, class_probabilities, classifier, cross_validation, cv_summary, fit_and_score, importances,
    logged_run, prepare_vars, rank_features, run_model,
)
from ..session import materialise, scratch_path
from ..sources.runs import load_model
from .registry import query, rounded, table

# Words used as model inputs: fixed values.
MODEL_WORDS = "th la en on de que le er tion und is".split()
INPUTS = [f"has_{w}" for w in MODEL_WORDS]
SMALL = {"lr": {"maxIter": 10}, "rf": {"numTrees": 10, "maxDepth": 4, "seed": 7}, "gbc": {"maxIter": 5, "maxDepth": 3, "seed": 7},
         "adaboost": {"maxIter": 8, "maxDepth": 2, "seed": 7}, "xgboost": {"maxIter": 5, "maxDepth": 3},
         "bnb": {}, "svm": {"maxIter": 10}}


def study_rows(spark, sf):
    docs = table(spark, sf, "documents")
    return presence_matrix(docs.withColumn("label", flag("lang", "fr")), "doc_id", "text", MODEL_WORDS, prefix="has_", label="label")


def vectors(spark, sf):
    rows = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(study_rows(spark, sf))
    return materialise(rows.select("doc_id", "features", "label"), "study-rows")


def register_fit(name: str) -> None:
    @query(f"M1_fit_{name}")
    def fit(spark, sf):
        rows = random_split(vectors(spark, sf), "doc_id", {"test": 0.3, "train": 0.7}, seed=7)
        train = rows.where("split = 'train'")
        _, scored = fit_and_score(train, rows, "label", name, keep=["split"], **SMALL[name])
        return rounded(evaluation(materialise(scored, "scored"), "label", "score", "prediction", by="split"))


for _name in SMALL:
    register_fit(_name)


@query("M2_repeated_runs")
def repeated(spark, sf):
    rows = vectors(spark, sf)
    n = rows.count()
    sizes = {"test": n // 5, "train": n // 2, "val": n // 5}
    results, _ = run_model(rows, "doc_id", "label", "lr", 2, sizes, seed=7, maxIter=5)
    return rounded(results.drop("fit_seconds"))


LOGGED_SQL = """SELECT run_id, CAST(n // 2 AS BIGINT) AS train_size, CAST(6 AS BIGINT) AS measured, true AS logged,
   CAST(n AS BIGINT) AS scored FROM (SELECT count(*) AS n FROM documents), (VALUES ('bnb'), ('bnb1'), ('lr')) t(run_id)"""


@query("M2_logged_run", LOGGED_SQL)
def logged(spark, sf):
    """Per run: whether the log line holds the means of the stored measures, and the rows its stored model scores."""
    rows, folder = vectors(spark, sf), scratch_path(spark, "study")
    n = rows.count()
    sizes = {"test": n // 5, "train": n // 2, "val": n // 5}
    ids = [
        logged_run(rows, "doc_id", "label", name, 2, sizes, folder, seed, **SMALL[name])
        for name, seed in (("bnb", 7), ("bnb", 8), ("lr", 7))
    ]
    means = spark.read.parquet(f"{folder}/results").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(
        F.count("*").alias("measured"), *[F.avg(F.when(F.col("split") == s, F.col("auc"))).alias(s) for s in ("train", "test")])
    log = spark.read.parquet(f"{folder}/log").withColumnRenamed("classifier", "run_id")
    same = (F.abs(F.col("auc_train") - F.col("train")) < 1e-9) & (F.abs(F.col("auc_test") - F.col("test")) < 1e-9)
    scored = [
        load_model(f"{folder}/models/{i}").transform(rows).where("prediction in (0, 1)").agg(
            F.lit(i).alias("run_id"), F.count("*").alias("scored")) for i in ids
    ]
    counts = scored[0].unionByName(scored[1]).unionByName(scored[2])
    return log.join(means, "run_id").join(counts, "run_id").select("run_id", "train_size", "measured", same.alias("logged"), "scored")


# the default ten folds and ten rounds; equal patterns of words have equal scores, so patterns are counted
BERNOULLI_CV_SQL = f"""WITH x AS MATERIALIZED (SELECT doc_id, CAST(coalesce(lang = 'fr', false) AS INTEGER) AS y,
       list_transform({MODEL_WORDS!r}, lambda w: coalesce(contains(text, w), false)) AS p FROM documents),
   k AS MATERIALIZED (SELECT r, y, p, ntile(10) OVER (PARTITION BY r, y ORDER BY md5(doc_id || ':' || (7 + r))) - 1 AS fold FROM x, range(10) t(r)),
   a AS MATERIALIZED (SELECT r, fold, y, p, count(*) AS n FROM k GROUP BY ALL),
   g AS MATERIALIZED (SELECT r, f, y, p, fold = f AS held, sum(n) AS n FROM a, range(10) t(f) GROUP BY ALL),
   s AS (SELECT r, f, sum(n) FILTER (y = 1) AS n1, sum(n) FILTER (y = 0) AS n0 FROM g WHERE NOT held GROUP BY r, f),
   c AS MATERIALIZED (SELECT r, f, i, (coalesce(sum(n) FILTER (p[i] AND y = 1), 0) + 1) / (n1 + 2) AS t1,
         (coalesce(sum(n) FILTER (p[i] AND y = 0), 0) + 1) / (n0 + 2) AS t0
         FROM g JOIN s USING (r, f), range(1, {len(MODEL_WORDS) + 1}) t(i) WHERE NOT held GROUP BY r, f, i, n1, n0),
   z AS (SELECT r, f, p, round(sum(CASE WHEN p[i] THEN ln(t1 / t0) ELSE ln((1 - t1) / (1 - t0)) END), 9) AS score
         FROM (SELECT DISTINCT r, f, p FROM g) JOIN c USING (r, f) GROUP BY r, f, p),
   v AS (SELECT r, f, held, score, CAST(sum(n * y) AS DOUBLE) AS pos, CAST(sum(n * (1 - y)) AS DOUBLE) AS neg FROM g JOIN z USING (r, f, p) GROUP BY ALL),
   u AS (SELECT *, sum(neg) OVER (PARTITION BY r, f, held ORDER BY score) - neg / 2 AS below FROM v),
   m AS (SELECT r, f, held, sum(pos * below) / sum(pos) / sum(neg) AS auc FROM u GROUP BY r, f, held)
   SELECT CAST(r AS INTEGER) AS round, CAST(f AS INTEGER) AS fold, round(max(auc) FILTER (NOT held), 6) AS auc_train,
          round(max(auc) FILTER (held), 6) AS auc_test FROM m GROUP BY r, f"""


@query("M3_cross_validation_bernoulli", BERNOULLI_CV_SQL)
def crossed_bernoulli(spark, sf):
    cv = cross_validation(vectors(spark, sf), "doc_id", "label", classifier("bnb"), parallelism=8)
    return rounded(cv.select("round", "fold", "auc_train", "auc_test"))


@query("M3_cross_validation")
def crossed(spark, sf):
    return rounded(cross_validation(vectors(spark, sf), "doc_id", "label", classifier("lr")))


@query("M3_cross_validation_under")
def crossed_under(spark, sf):
    cv = cross_validation(
        vectors(spark, sf), "doc_id", "label", classifier("bnb"), n_fold=3, n_round=1, resampler=Resampler("under", 1.0)
    )
    return rounded(cv_summary(cv))


@query("M3_cross_validation_smote")
def crossed_smote(spark, sf):
    cv = cross_validation(
        vectors(spark, sf), "doc_id", "label", classifier("lr", maxIter=5), n_fold=2, n_round=1,
        resampler=Resampler("smote", 0.8, k=3),
    )
    return rounded(cv_summary(cv))


def boosted_sql(rounds: int, depth: int, folds: int | None = None) -> tuple[str, list[str]]:
    """CTEs that boost by hand over the counted patterns of words, a block per round and level; and the names of the state
    after each round, ``(m, fold, p, y, n, margin)``."""
    split = (f"ntile({folds}) OVER (PARTITION BY y ORDER BY md5(doc_id || ':' || 7)) - 1" if folds else "-1")
    models = folds or 1
    ctes = [
        f"""x AS MATERIALIZED (SELECT doc_id, CAST(coalesce(lang = 'fr', false) AS INTEGER) AS y,
          list_transform({MODEL_WORDS!r}, lambda w: CAST(coalesce(contains(text, w), false) AS INTEGER)) AS p FROM documents)""",
        f"k AS (SELECT y, p, {split} AS fold FROM x)",
        f"""t0 AS MATERIALIZED (SELECT m, fold, p, y, count(*) AS n, CAST(0 AS DOUBLE) AS margin FROM k, range({models}) u(m) GROUP BY ALL)""",
    ]
    states = []
    for r in range(rounds):
        ctes.append(f"""r{r}_0 AS MATERIALIZED (SELECT *, 1 AS node, true AS open, CAST(0 AS DOUBLE) AS value,
          1 / (1 + exp(-margin)) AS q FROM t{r})""")
        for d in range(depth):
            ctes.append(f"""b{r}_{d} AS MATERIALIZED (SELECT *, round(CASE WHEN nl < n AND round(hl, 9) >= 1 AND round(h - hl, 9) >= 1
                 THEN gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) ELSE -1 END, 9) AS gain
              FROM (SELECT m, node, i, coalesce(sum(n * (q - y)) FILTER (p[i] = 0), 0) AS gl, coalesce(sum(n * q * (1 - q)) FILTER (p[i] = 0), 0) AS hl,
                  coalesce(sum(n) FILTER (p[i] = 0), 0) AS nl, sum(n * (q - y)) AS g, sum(n * q * (1 - q)) AS h, sum(n) AS n
                FROM r{r}_{d}, range(1, {len(MODEL_WORDS) + 1}) u(i) WHERE open AND fold <> m GROUP BY m, node, i)
              QUALIFY row_number() OVER (PARTITION BY m, node ORDER BY gain DESC, i) = 1)""")
            ctes.append(f"""r{r}_{d + 1} AS MATERIALIZED (SELECT s.m, s.fold, s.p, s.y, s.n, s.margin,
                CASE WHEN b.gain > 0 AND s.open THEN 2 * s.node + s.p[b.i] ELSE s.node END AS node, s.open AND coalesce(b.gain > 0, false) AS open,
                CASE WHEN b.node IS NULL OR NOT s.open THEN s.value WHEN b.gain > 0 AND s.p[b.i] = 0 THEN -0.3 * b.gl / (b.hl + 1)
                     WHEN b.gain > 0 THEN -0.3 * (b.g - b.gl) / (b.h - b.hl + 1) WHEN s.node = 1 THEN -0.3 * b.g / (b.h + 1) ELSE s.value END AS value, s.q
              FROM r{r}_{d} s LEFT JOIN b{r}_{d} b ON b.m = s.m AND b.node = s.node)""")
        ctes.append(f"t{r + 1} AS MATERIALIZED (SELECT m, fold, p, y, n, margin + value AS margin FROM r{r}_{depth})")
        states.append(f"t{r + 1}")
    return "WITH " + ",\n".join(ctes), states


CURVE_ROUNDS = 12
_CURVE, _STATES = boosted_sql(CURVE_ROUNDS, 2, 3)
# three folds; the curve ends two rounds after its best test measure, which is before the last round here
CURVE_SQL = f"""{_CURVE},
   g AS (SELECT m, r, fold = m AS test, margin, CAST(sum(n * y) AS DOUBLE) AS pos, CAST(sum(n * (1 - y)) AS DOUBLE) AS neg
         FROM ({" UNION ALL ".join(f"SELECT {k + 1} AS r, * FROM {t}" for k, t in enumerate(_STATES))}) GROUP BY ALL),
   u AS (SELECT *, sum(neg) OVER (PARTITION BY m, r, test ORDER BY margin) - neg / 2 AS below FROM g),
   a AS (SELECT m, r, test, round(sum(pos * below) / sum(pos) / sum(neg), 12) AS auc FROM u GROUP BY m, r, test),
   c AS MATERIALIZED (SELECT r, round(avg(auc) FILTER (NOT test), 12) AS train, round(avg(auc) FILTER (test), 12) AS test FROM a GROUP BY r),
   best AS (SELECT c.*, max(c.test) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
   since AS (SELECT *, r - max(CASE WHEN before IS NULL OR test > before THEN r END) OVER (ORDER BY r) AS stale FROM best),
   stop AS (SELECT least(coalesce(min(r) FILTER (stale >= 2), {CURVE_ROUNDS}), {CURVE_ROUNDS}) AS last FROM since)
   SELECT CAST(r AS INTEGER) AS rounds, round(train, 6) AS auc_train, round(test, 6) AS auc_test,
     CAST(least({CURVE_ROUNDS}, 4 * ((last + 3) // 4)) AS INTEGER) AS trained FROM c, stop WHERE r <= last"""


@query("M4_early_stopping", CURVE_SQL)
def stopped(spark, sf):
    return rounded(boosting_rounds(vectors(spark, sf), "doc_id", "label", max_rounds=CURVE_ROUNDS, early_stop=2, maxDepth=2))


def boosted(spark, sf):
    rows = vectors(spark, sf)
    return rows, classifier("xgboost", maxIter=5, maxDepth=3).fit(rows)


_BOOSTED, _GROWN = boosted_sql(5, 3)
PROBABILITIES_SQL = f"""{_BOOSTED}
   SELECT doc_id, round(1 - 1 / (1 + exp(-margin)), 6) AS p0, round(1 / (1 + exp(-margin)), 6) AS p1, x.y AS label
   FROM x JOIN (SELECT DISTINCT p, margin FROM {_GROWN[-1]}) USING (p)"""


@query("M5_class_probabilities", PROBABILITIES_SQL)
def probabilities(spark, sf):
    rows, model = boosted(spark, sf)
    return rounded(class_probabilities(model, rows).select("doc_id", "p0", "p1", "label"))


BERNOULLI_SQL = f"""WITH x AS (SELECT doc_id, lang = 'fr' AS y, unnest({MODEL_WORDS!r}) AS w, text FROM documents),
   h AS (SELECT doc_id, y, w, contains(text, w) AS has FROM x),
   s AS (SELECT count(*) FILTER (lang = 'fr') AS n1, count(*) FILTER (lang <> 'fr') AS n0 FROM documents),
   c AS (SELECT w, (count(*) FILTER (has AND y) + 1) / (n1 + 2) AS t1, (count(*) FILTER (has AND NOT y) + 1) / (n0 + 2) AS t0
         FROM h, s GROUP BY w, n1, n0),
   z AS (SELECT doc_id, sum(ln(CASE WHEN has THEN t1 / t0 ELSE (1 - t1) / (1 - t0) END)) AS d FROM h JOIN c USING (w) GROUP BY doc_id)
   SELECT doc_id, round(1 / (1 + exp(-(d + ln((n1 + 1) / (n0 + 1))))), 6) AS p1 FROM z, s"""


@query("M5_bernoulli_probabilities", BERNOULLI_SQL)
def bernoulli(spark, sf):
    rows = vectors(spark, sf)
    model = classifier("bnb").fit(rows)
    return rounded(class_probabilities(model, rows).select("doc_id", "p1"))


IMPORTANCES_SQL = f"""{_BOOSTED},
   s AS (SELECT i, avg(gain) AS gain, avg(h) AS cover, count(*) AS weight
         FROM ({" UNION ALL ".join(f"SELECT i, gain, h FROM b{r}_{d}" for r in range(5) for d in range(3))}) WHERE gain > 0 GROUP BY i)
   SELECT 'has_' || w AS feature, round(coalesce(gain, 0), 6) AS gain, round(coalesce(cover, 0), 6) AS cover, coalesce(weight, 0) AS weight
   FROM (SELECT unnest({MODEL_WORDS!r}) AS w, unnest(range(1, {len(MODEL_WORDS) + 1})) AS j) LEFT JOIN s ON i = j"""


@query("M5_importances", IMPORTANCES_SQL)
def gains(spark, sf):
    _, model = boosted(spark, sf)
    return rounded(importances(model, INPUTS))


def elimination_sql() -> str:
    """Ten rounds of ten folds, a block of CTEs for each feature that goes."""
    width = len(MODEL_WORDS)
    ctes = [
        f"""x AS MATERIALIZED (SELECT doc_id, CAST(coalesce(lang = 'fr', false) AS INTEGER) AS y,
          list_transform({MODEL_WORDS!r}, lambda w: CAST(coalesce(contains(text, w), false) AS INTEGER)) AS p FROM documents)""",
        "k AS (SELECT r, y, p, ntile(10) OVER (PARTITION BY r, y ORDER BY md5(doc_id || ':' || (7 + r))) - 1 AS fold FROM x, range(10) t(r))",
        "a AS MATERIALIZED (SELECT r, fold, y, p, count(*) AS n FROM k GROUP BY ALL)",
        "g AS MATERIALIZED (SELECT r, f, y, p, fold = f AS held, sum(n) AS n FROM a, range(10) t(f) GROUP BY ALL)",
        "s AS (SELECT r, f, sum(n) FILTER (y = 1) AS n1, sum(n) FILTER (y = 0) AS n0 FROM g WHERE NOT held GROUP BY r, f)",
        f"""c AS (SELECT r, f, n1, n0, i, (coalesce(sum(n) FILTER (p[i] = 1 AND y = 1), 0) + 1) / (n1 + 2) AS t1,
          (coalesce(sum(n) FILTER (p[i] = 1 AND y = 0), 0) + 1) / (n0 + 2) AS t0
          FROM g JOIN s USING (r, f), range(1, {width + 1}) t(i) WHERE NOT held GROUP BY r, f, i, n1, n0)""",
        """w AS MATERIALIZED (SELECT r, f, ln((n1 + 1) / (n0 + 1)) AS prior, list(ln(t1 / t0) ORDER BY i) AS hit,
          list(ln((1 - t1) / (1 - t0)) ORDER BY i) AS miss FROM c GROUP BY r, f, n1, n0)""",
        f"pool0 AS MATERIALIZED (SELECT range(1, {width + 1}) AS pool)",
    ]
    for step in range(width):
        candidates = "(SELECT pool, 0 AS j FROM pool0)" if step == 0 else f"(SELECT pool, unnest(pool) AS j FROM pool{step - 1})"
        ctes += [
            f"""v{step} AS MATERIALIZED (SELECT r, f, held, j, round(prior + list_sum(list_transform(pool, lambda i: CASE WHEN i = j THEN 0
              WHEN p[i] = 1 THEN hit[i] ELSE miss[i] END)), 9) AS score, CAST(sum(n * y) AS DOUBLE) AS pos, CAST(sum(n * (1 - y)) AS DOUBLE) AS neg
              FROM g JOIN w USING (r, f), {candidates} GROUP BY ALL)""",
            f"u{step} AS (SELECT *, sum(neg) OVER (PARTITION BY r, f, held, j ORDER BY score) - neg / 2 AS below FROM v{step})",
            f"m{step} AS (SELECT r, f, held, j, sum(pos * below) / sum(pos) / sum(neg) AS auc FROM u{step} GROUP BY r, f, held, j)",
            f"""b{step} AS MATERIALIZED (SELECT j, avg(auc) FILTER (NOT held) AS auc_train, avg(auc) FILTER (held) AS auc_test FROM m{step} GROUP BY j
              ORDER BY round(auc_test, 12) DESC, j LIMIT 1)""",
        ]
        if step:
            ctes.append(f"pool{step} AS MATERIALIZED (SELECT list_filter(pool, lambda i: i <> j) AS pool FROM pool{step - 1}, b{step})")
    # each step tells the feature that goes next; the last one the survivor
    going = [f"(SELECT j FROM b{step + 1})" for step in range(width - 1)] + [f"(SELECT pool[1] FROM pool{width - 1})"]
    names = [f"'has_{w}'" for w in MODEL_WORDS]
    rows = " UNION ALL ".join(
        f"SELECT {width - step} AS num_var, auc_train, auc_test, {gone} AS gone FROM b{step}" for step, gone in enumerate(going))
    return f"""WITH {", ".join(ctes)} SELECT CAST(num_var AS INTEGER) AS num_var, round(auc_train, 6) AS auc_train, round(auc_test, 6) AS auc_test,
      [{", ".join(names)}][gone] AS removed FROM ({rows})"""


def elimination_rows(spark, sf):
    return materialise(study_rows(spark, sf).select("doc_id", "label", *INPUTS), "elimination")


@query("M6_backward_elimination")
def eliminated(spark, sf):
    return rounded(rank_features(elimination_rows(spark, sf), "doc_id", "label", INPUTS, name="lr"))


@query("M6_backward_elimination_bernoulli", elimination_sql())
def eliminated_bernoulli(spark, sf):
    return rounded(rank_features(elimination_rows(spark, sf), "doc_id", "label", INPUTS, name="bnb"))


PREPARED_SQL = """WITH s AS (SELECT (o_totalprice - avg(o_totalprice) OVER ()) / stddev(o_totalprice) OVER () AS v0, o_orderpriority AS p, o_orderstatus AS t FROM orders),
   pc AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM (SELECT DISTINCT p FROM s)),
   tc AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM s)),
   np AS (SELECT count(*) AS n FROM pc), nt AS (SELECT count(*) AS n FROM tc),
   v AS (SELECT 0 AS position, v0 AS v FROM s
         UNION ALL SELECT pc.i, CAST(s.p = pc.p AS INTEGER) FROM s, pc UNION ALL SELECT n + 1, 0 FROM s, np
         UNION ALL SELECT np.n + 1 + tc.i, CAST(s.t = tc.t AS INTEGER) FROM s, tc, np
         UNION ALL SELECT np.n + nt.n + 2, 0 FROM s, np, nt)
   SELECT CAST(position AS INTEGER) AS position, round(avg(v), 6) + 0.0 AS mean, round(stddev(v), 6) AS std FROM v GROUP BY position"""


@query("M7_prepare_inputs", PREPARED_SQL)
def prepared(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    encoded, _ = prepare_vars(orders, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    values = encoded.select(F.posexplode(vector_to_array("features")).alias("position", "v"))
    return rounded(values.groupBy("position").agg(F.avg("v").alias("mean"), F.stddev("v").alias("std")))
