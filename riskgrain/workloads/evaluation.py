"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flag
from ..operators.evaluate import (
    accuracy, auc, confusion, evaluation, ks, ks_points, metric_summary, roc_points, split_performance, threshold_rates,
)
from ..operators.sampling import nested_split, stratified_folds
from .registry import query, rounded, table

THRESHOLDS = [0.5, 5.0, 10.0, 25.0, 40.0, 1000.0]


def ks_sql(rows: str, n_bin: int) -> str:
    """CTEs of the KS definition by rescanning all rows per threshold; ``rows`` has g, y, s."""
    return f"""x AS MATERIALIZED ({rows}),
       b AS (SELECT g, s, ntile({n_bin}) OVER (PARTITION BY g ORDER BY s) AS t FROM x),
       th AS (SELECT DISTINCT g, max(s) AS threshold FROM b GROUP BY g, t),
       kp AS (SELECT g, threshold, count(*) FILTER (y AND s >= threshold) AS tp, count(*) FILTER (NOT y AND s >= threshold) AS fp,
                     count(*) FILTER (y AND s >= threshold) / nullif(count(*) FILTER (y), 0) AS tpr,
                     count(*) FILTER (NOT y AND s >= threshold) / nullif(count(*) FILTER (NOT y), 0) AS fpr
              FROM th JOIN x USING (g) GROUP BY ALL),
       ksv AS (SELECT g, abs(max(tpr - fpr)) AS ks FROM kp GROUP BY g)"""


AUC_CTES = """h AS (SELECT g, s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM x GROUP BY g, s),
   c AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY s) - n AS below FROM h),
   aucv AS (SELECT g, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY g)"""

EVENT_ROWS = "SELECT 'all' AS g, event_type = 'purchase' AS y, value AS s FROM events"
TIED_ROWS = "SELECT 'all' AS g, l_returnflag = 'R' AS y, l_discount + 0.0 AS s FROM lineitem"
PRICE_ROWS = "SELECT 'all' AS g, l_returnflag = 'R' AS y, l_extendedprice AS s FROM lineitem"


def purchases(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", flag("event_type", "purchase").alias("y"))


def returns(spark, sf, score):
    return table(spark, sf, "lineitem").select(F.col(score).alias("s"), flag("l_returnflag", "R").alias("y"))


@query(
    "E1_tpr_fpr",
    f"""WITH t AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold), x AS ({EVENT_ROWS})
       SELECT threshold, count(*) FILTER (y AND s >= threshold) AS tp, count(*) FILTER (NOT y AND s >= threshold) AS fp,
              round(count(*) FILTER (y AND s >= threshold) / count(*) FILTER (y), 6) AS tpr,
              round(count(*) FILTER (NOT y AND s >= threshold) / count(*) FILTER (NOT y), 6) AS fpr
       FROM t, x GROUP BY threshold""",
)
def rates(spark, sf):
    return rounded(threshold_rates(purchases(spark, sf), "y", "value", THRESHOLDS))


@query("E2_ks", f"WITH {ks_sql(EVENT_ROWS, 20)} SELECT round(ks, 6) AS ks FROM ksv")
def ks_events(spark, sf):
    return rounded(ks(purchases(spark, sf), "y", "value"))


@query("E2_ks_ties", f"WITH {ks_sql(TIED_ROWS, 20)} SELECT round(ks, 6) AS ks FROM ksv")
def ks_ties(spark, sf):
    return rounded(ks(returns(spark, sf, "l_discount"), "y", "s"))


@query(
    "E2_ks_points",
    f"""WITH {ks_sql(PRICE_ROWS, 50)} SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM kp""",
)
def ks_curve(spark, sf):
    return rounded(ks_points(returns(spark, sf, "l_extendedprice"), "y", "s", n_bin=50))


ROC_SQL = """WITH x AS ({rows}), d AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM x GROUP BY s),
   r AS (SELECT s AS threshold, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () AS fpr FROM d)
   SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r
   UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0"""


@query("E3_roc_points", ROC_SQL.format(rows=EVENT_ROWS))
def roc(spark, sf):
    return rounded(roc_points(purchases(spark, sf), "y", "value"))


@query("E3_roc_points_bucketed", ROC_SQL.format(rows=PRICE_ROWS))
def roc_bucketed(spark, sf):
    return rounded(roc_points(returns(spark, sf, "l_extendedprice"), "y", "s", bucket_rows=7000))


@query("E4_auc", f"WITH x AS ({PRICE_ROWS}), {AUC_CTES} SELECT round(auc, 6) AS auc FROM aucv")
def auc_price(spark, sf):
    return rounded(auc(returns(spark, sf, "l_extendedprice"), "y", "s"))


@query("E4_auc_ties", f"WITH x AS ({TIED_ROWS}), {AUC_CTES} SELECT round(auc, 6) AS auc FROM aucv")
def auc_ties(spark, sf):
    return rounded(auc(returns(spark, sf, "l_discount"), "y", "s"))


@query(
    "E4_auc_per_group",
    f"""WITH x AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS y, o_totalprice AS s FROM orders), {AUC_CTES}
        SELECT g AS o_orderpriority, round(auc, 6) AS auc FROM aucv""",
)
def auc_groups(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", flag("o_orderstatus", "F"))
    return rounded(auc(orders, "y", "o_totalprice", by="o_orderpriority"))


@query(
    "E4_auc_many_groups",
    f"""WITH x AS (SELECT l_partkey AS g, l_returnflag = 'R' AS y, l_extendedprice AS s FROM lineitem), {AUC_CTES}
        SELECT CAST(g AS VARCHAR) AS l_partkey, round(auc, 6) AS auc FROM aucv""",
)
def auc_many_groups(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("y", flag("l_returnflag", "R"))
    return rounded(auc(rows, "y", "l_extendedprice", by="l_partkey", bucket_rows=5_000))


CONFUSION_SQL = """WITH x AS (SELECT event_type = 'purchase' AS y, value >= 10 AS q FROM events),
   k AS (SELECT count(*) FILTER (y AND q) AS tp, count(*) FILTER (NOT y AND q) AS fp, count(*) FILTER (NOT y AND NOT q) AS tn,
                count(*) FILTER (y AND NOT q) AS fn, count(*) AS total FROM x)"""


@query(
    "E5_confusion_matrix",
    CONFUSION_SQL
    + """ SELECT *, round((tp + tn) / total, 6) AS accuracy, round((fp + fn) / total, 6) AS misclassification,
       round(tp / (tp + fn), 6) AS true_positive_rate, round(tp / (tp + fn), 6) AS sensitivity, round(tp / (tp + fn), 6) AS recall,
       round(fp / (fp + tn), 6) AS false_positive_rate, round(tn / (fp + tn), 6) AS specificity,
       round(tp / (tp + fp), 6) AS precision, round((tp + fn) / total, 6) AS prevalence FROM k""",
)
def matrix(spark, sf):
    rows = purchases(spark, sf).withColumn("pred", (F.col("value") >= 10).cast("int"))
    return rounded(confusion(rows, "y", "pred"))


@query("E6_accuracy", CONFUSION_SQL + " SELECT round((tp + tn) / total, 6) AS accuracy FROM k")
def right_share(spark, sf):
    rows = purchases(spark, sf).withColumn("pred", (F.col("value") >= 10).cast("int"))
    return rounded(accuracy(rows, "y", "pred"))


FOLD_ROWS = """SELECT 'f' || (ntile(5) OVER (PARTITION BY event_type = 'purchase' ORDER BY md5(event_id || ':3')) - 1) AS g,
   event_type = 'purchase' AS y, value AS s FROM events"""


@query(
    "E7_metric_summary",
    f"""WITH {ks_sql(FOLD_ROWS, 20)}, {AUC_CTES}
       SELECT 'auc' AS metric, round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std FROM aucv
       UNION ALL SELECT 'ks', round(avg(ks), 6), round(stddev_pop(ks), 6) FROM ksv""",
)
def summary(spark, sf):
    rows = stratified_folds(purchases(spark, sf), "event_id", "y", 5, seed=3)
    results = evaluation(rows, "y", "value", by="fold")
    return rounded(metric_summary(results, ["auc", "ks"]))


SPLIT_ROWS = """SELECT r.round || '-' || r.split AS g, y, s, q FROM
   (SELECT CAST(i AS VARCHAR) AS round, CASE WHEN n <= ceil(0.3 * t) THEN 'test'
             WHEN n <= ceil(0.3 * t) + ceil(0.25 * (t - ceil(0.3 * t))) THEN 'val' ELSE 'train' END AS split, y, s, q
    FROM (SELECT i, event_type = 'purchase' AS y, value AS s, value >= 10 AS q, count(*) OVER (PARTITION BY i) AS t,
                 row_number() OVER (PARTITION BY i ORDER BY md5(event_id || ':' || i)) AS n
          FROM events, range(1, 4) r(i))) r"""


@query(
    "E8_split_performance",
    f"""WITH {ks_sql(SPLIT_ROWS, 20)}, {AUC_CTES}, acc AS (SELECT g, avg(CAST(y = q AS INTEGER)) AS acc FROM x GROUP BY g),
       m AS (SELECT split_part(g, '-', 2) AS split, auc, ks, acc FROM aucv JOIN ksv USING (g) JOIN acc USING (g)),
       l AS (UNPIVOT m ON auc, ks, acc INTO NAME metric VALUE v)
       SELECT metric, round(avg(v) FILTER (split = 'train'), 6) AS train, round(avg(v) FILTER (split = 'val'), 6) AS val,
              round(avg(v) FILTER (split = 'test'), 6) AS test FROM l GROUP BY metric""",
)
def performance(spark, sf):
    rows = purchases(spark, sf).withColumn("pred", (F.col("value") >= 10).cast("int"))
    runs = None
    for seed in (1, 2, 3):
        split = nested_split(rows, "event_id", 0.3, 0.25, seed=seed)
        measured = evaluation(split, "y", "value", "pred", by="split")
        runs = measured if runs is None else runs.unionByName(measured)
    return rounded(split_performance(runs))
