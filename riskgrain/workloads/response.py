"""Response-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flag, number
from ..operators.binning import assign_bins, bin_numeric
from ..operators.edges import explicit
from ..operators.profile import box_summary, flag_outliers, length_histogram, null_counts, outlier_fences, ranges
from ..operators.response import (
    category_profiles, category_response, class_measures, group_woe, interval_response, information_value,
    iv_from_groups, plot_series, smoothed_woe, with_empty_bins, with_ends, woe_table,
)
from .registry import query, rounded, table

FLAGSHIP_SQL = """
WITH q AS (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS e FROM customer),
x AS (SELECT CASE WHEN c_acctbal <= e[1] THEN 0 WHEN c_acctbal <= e[2] THEN 1 WHEN c_acctbal <= e[3] THEN 2
                  WHEN c_acctbal <= e[4] THEN 3 ELSE 4 END AS bin, c_mktsegment = 'BUILDING' AS y FROM customer, q),
g AS (SELECT bin, count(*) AS count, count(*) FILTER (y) AS positive, count(*) FILTER (NOT y) AS negative FROM x GROUP BY bin),
t AS (SELECT sum(positive) AS tp, sum(negative) AS tn FROM g),
w AS (SELECT g.*, tp, tn, ln((positive / tp) / (negative / tn)) AS woe FROM g, t),
v AS (SELECT *, (positive / tp - negative / tn) * woe AS iv FROM w)
SELECT bin, count, round(count / (tp + tn), 6) AS tot_distr, negative, round(negative / tn, 6) AS neg_distr, positive,
       round(positive / tp, 6) AS pos_distr, round(positive / count, 6) AS bad_rate, round(woe, 6) AS woe, round(iv, 6) AS iv,
       round((SELECT sum(iv) FROM v), 6) AS iv_total, round((SELECT sum(iv) FROM v), 6) AS iv_finite,
       round(CASE WHEN bin = 0 THEN CAST('-inf' AS DOUBLE) ELSE (SELECT e[bin] FROM q) END, 6) AS lo,
       round(CASE WHEN bin = 4 THEN CAST('inf' AS DOUBLE) ELSE (SELECT e[bin + 1] FROM q) END, 6) AS hi
FROM v"""


@query("A2_woe_table", FLAGSHIP_SQL)
def woe_of_balance(spark, sf):
    cu = table(spark, sf, "customer").select("c_acctbal", flag("c_mktsegment", "BUILDING").alias("label"))
    binned, edges = bin_numeric(cu, "c_acctbal", 5, "even_depth", edge="inf")
    return rounded(with_ends(woe_table(binned, "label", "bin_id"), edges))


@query(
    "A2_woe_missing_bin",
    """WITH x AS (SELECT nullif(l_discount, 0) AS v, l_returnflag AS y FROM lineitem),
       b AS (SELECT CASE WHEN v > 0.005 AND v <= 0.035 THEN 0 WHEN v > 0.035 AND v <= 0.065 THEN 1
                         WHEN v > 0.065 AND v <= 0.085 THEN 2 ELSE -1 END AS bin, y FROM x),
       g AS (SELECT bin, count(*) AS count, count(*) FILTER (y = 'R') AS positive, count(*) FILTER (y = 'A') AS negative,
                    count(*) FILTER (y = 'N') AS bad FROM b GROUP BY bin),
       t AS (SELECT sum(positive) AS tp, sum(negative) AS tn FROM g),
       w AS (SELECT g.*, tp, tn, ln((positive / tp) / (negative / tn)) AS woe FROM g, t)
       SELECT bin, count, round(count / (tp + tn), 6) AS tot_distr, positive, negative, round(bad / count, 6) AS bad_rate,
              round(woe, 6) AS woe, round((positive / tp - negative / tn) * woe, 6) AS iv FROM w""",
)
def woe_missing(spark, sf):
    li = table(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("v"), "l_returnflag")
    binned = assign_bins(li, "v", [0.005, 0.035, 0.065, 0.085])
    result = woe_table(binned, "l_returnflag", "bin_id", pos="R", neg="A", bad="N", smoothing="never")
    return rounded(result.select("bin", "count", "tot_distr", "positive", "negative", "bad_rate", "woe", "iv"))


def pure_sql(smoothing: str) -> str:
    add = {"auto": "CASE WHEN positive = 0 OR negative = 0 THEN 1 ELSE 0 END", "always": "1", "never": "0"}[smoothing]
    return f"""WITH x AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'missing' ELSE o_orderstatus || substr(o_orderpriority, 1, 1) END AS bin,
              CAST(o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS INTEGER) AS y FROM orders),
       g AS (SELECT bin, count(*) AS count, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative FROM x GROUP BY bin),
       t AS (SELECT sum(positive) AS tp, sum(negative) AS tn FROM g),
       s AS (SELECT g.*, tp, tn, positive + {add} AS ps, negative + {add} AS ns FROM g, t),
       w AS (SELECT *, CASE WHEN ns = 0 THEN CAST('inf' AS DOUBLE) WHEN ps = 0 THEN CAST('-inf' AS DOUBLE)
                            ELSE ln((ps / tp) / (ns / tn)) END AS woe FROM s),
       v AS (SELECT *, CASE WHEN ns = 0 OR ps = 0 THEN CAST('inf' AS DOUBLE) ELSE (ps / tp - ns / tn) * woe END AS iv FROM w)
       SELECT bin, count, positive, negative, round(pos, 6) AS pos_distr, round(woe, 6) AS woe, round(iv, 6) AS iv,
              round((SELECT sum(iv) FROM v), 6) AS iv_total,
              round((SELECT coalesce(sum(iv) FILTER (iv < CAST('inf' AS DOUBLE)), 0) FROM v), 6) AS iv_finite
       FROM (SELECT *, positive / tp AS pos FROM v)"""


def register_pure(smoothing: str) -> None:
    @query(f"A2_woe_smoothing_{smoothing}", pure_sql(smoothing))
    def pure_groups(spark, sf):
        status, key = F.col("o_orderstatus"), F.col("o_orderkey")
        rows = table(spark, sf, "orders").select(
            F.when(status == "O", F.lit("missing"))
            .otherwise(F.concat(status, F.substring("o_orderpriority", 1, 1))).alias("bin"),
            ((status == "F") | ((status == "O") & (key % 3 == 0))).cast("int").alias("label"),
        )
        result = woe_table(rows, "label", "bin", kind="c", smoothing=smoothing)
        return rounded(result.select("bin", "count", "positive", "negative", "pos_distr", "woe", "iv", "iv_total", "iv_finite"))


for _smoothing in ("auto", "always", "never"):
    register_pure(_smoothing)


@query(
    "A2_information_value",
    """WITH g AS (SELECT p_brand AS bin, count(*) FILTER (p_size <= 10) AS p, count(*) FILTER (p_size > 10) AS n FROM part GROUP BY 1),
       t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM g),
       w AS (SELECT ((p + a) / tp - (n + a) / tn) * ln(((p + a) / tp) / ((n + a) / tn)) AS iv
             FROM (SELECT *, CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END AS a FROM g), t)
       SELECT round(sum(iv), 6) AS iv_total, round(sum(iv), 6) AS iv_finite FROM w""",
)
def iv_only(spark, sf):
    part = table(spark, sf, "part").select("p_brand", (F.col("p_size") <= 10).cast("int").alias("label"))
    return rounded(information_value(woe_table(part, "label", "p_brand", kind="c")))


@query(
    "A2_woe_empty_bins",
    """WITH e AS (SELECT CAST(i AS INTEGER) AS bin, i * 25.0 AS lo, i * 25.0 + 25 AS hi FROM range(3) t(i)),
       g AS (SELECT bin, count(p_size) AS count, count(*) FILTER (p_brand = 'Brand#1') AS positive,
                    count(*) FILTER (p_brand <> 'Brand#1') AS negative
             FROM e LEFT JOIN part ON p_size > lo AND p_size <= hi GROUP BY bin)
       SELECT bin, count, positive, negative, CASE WHEN count > 0 THEN round(positive / count, 6) END AS bad_rate FROM g""",
)
def woe_with_empty(spark, sf):
    edges = explicit([0, 25, 50, 75])
    part = table(spark, sf, "part").select("p_size", flag("p_brand", "Brand#1").alias("label"))
    result = with_empty_bins(woe_table(assign_bins(part, "p_size", edges), "label", "bin_id"), edges)
    return rounded(result.select("bin", "count", "positive", "negative", "bad_rate"))


@query(
    "A1_group_woe",
    """WITH g AS (SELECT o_orderpriority, count(*) AS count, count(*) FILTER (o_orderstatus = 'F') AS positive,
                         count(*) FILTER (o_orderstatus <> 'F') AS negative FROM orders GROUP BY 1),
       w AS (SELECT *, ln(((positive + 1) / 50000) / ((negative + 1) / 90000)) AS woe FROM g)
       SELECT o_orderpriority, count, round(count / 140000, 6) AS tot_distr, positive, round(positive / 50000, 6) AS pos_distr,
              negative, round(negative / 90000, 6) AS neg_distr, round(positive / count, 6) AS bad_rate, round(woe, 6) AS woe,
              round(((positive + 1) / 50000 - (negative + 1) / 90000) * woe, 6) AS iv FROM w""",
)
def one_group(spark, sf):
    orders = table(spark, sf, "orders").withColumn("label", flag("o_orderstatus", "F"))
    return rounded(group_woe(orders, "label", 50000, 90000, smoothing="always", by=["o_orderpriority"]))


@query(
    "A3_smoothed_woe",
    """WITH x AS (SELECT CASE WHEN p_size <= 10 THEN NULL ELSE CAST(p_size % 7 AS VARCHAR) END AS bin,
                         CASE WHEN p_type <> 'SMALL' THEN CAST(p_retailprice > 1000 AS INTEGER) END AS y FROM part),
       g AS (SELECT coalesce(bin, 'nan') AS bin, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative
             FROM x WHERE y IS NOT NULL GROUP BY 1),
       t AS (SELECT sum(positive) AS tp, sum(negative) AS tn FROM g),
       w AS (SELECT g.*, (positive + 1) / (tp + 2) AS a, (negative + 1) / (tn + 2) AS b FROM g, t)
       SELECT bin, positive, negative, round(ln(a / b), 6) AS woe, round((a - b) * ln(a / b), 6) AS iv,
              round((SELECT sum((a - b) * ln(a / b)) FROM w), 6) AS iv_total FROM w""",
)
def smoothed(spark, sf):
    part = table(spark, sf, "part").select(
        F.when(F.col("p_size") > 10, F.col("p_size") % 7).alias("bin"),
        F.when(F.col("p_type") != "SMALL", F.col("p_retailprice") > 1000).alias("y"),
    )
    return rounded(smoothed_woe(part, "y", "bin"))


def grouped_iv_sql(add: int) -> str:
    return f"""WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') + {add} AS p,
                    count(*) FILTER (o_orderstatus <> 'F') + {add} AS n FROM orders GROUP BY 1),
       t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM g)
       SELECT round(sum((p / tp - n / tn) * ln((p / tp) / (n / tn))), 9) AS iv FROM g, t"""


def register_grouped_iv(name: str, smooth: bool) -> None:
    @query(name, grouped_iv_sql(int(smooth)))
    def grouped_iv(spark, sf):
        orders = table(spark, sf, "orders").withColumn("label", flag("o_orderstatus", "F"))
        groups = category_response(orders, "o_orderpriority", "label")
        return rounded(iv_from_groups(groups, smooth=smooth), 9)


register_grouped_iv("A4_iv_from_groups", True)
register_grouped_iv("A4_iv_from_groups_plain", False)


@query(
    "A5_interval_response",
    """WITH e AS (SELECT * FROM (VALUES (0, 0.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 35.0)) t(bin, lo, hi)),
       x AS (SELECT coalesce(bin, -1) AS bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, l_returnflag = 'R' AS y
             FROM lineitem LEFT JOIN e ON l_quantity > lo AND l_quantity <= hi)
       SELECT bin, lo AS min, hi AS max, count(*) AS sum, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n,
              round(count(*) FILTER (y) / count(*), 6) AS pr, round(count(*) FILTER (NOT y) / count(*), 6) AS nr,
              round((SELECT count(*) FILTER (y) / count(*) FROM x), 6) AS overall_pr
       FROM x GROUP BY ALL""",
)
def intervals(spark, sf):
    edges = explicit([0, 10, 20, 35])
    li = table(spark, sf, "lineitem").select("l_quantity", flag("l_returnflag", "R").alias("y"))
    return rounded(interval_response(assign_bins(li, "l_quantity", edges), "y", edges))


@query(
    "A6_category_response",
    """WITH x AS (SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'missing') AS category, o_orderstatus = 'F' AS y FROM orders)
       SELECT category, count(*) AS sum, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n,
              round(count(*) FILTER (y) / count(*), 6) AS pr, round(count(*) FILTER (NOT y) / count(*), 6) AS nr,
              round((SELECT count(*) FILTER (y) / count(*) FROM x), 6) AS overall_pr
       FROM x GROUP BY category""",
)
def by_category(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), flag("o_orderstatus", "F").alias("label")
    )
    return rounded(category_response(orders, "priority", "label"))


MEASURE_SQL = """WITH k AS (SELECT {by}, {v} AS v, count(*) AS k FROM {t} WHERE {v} IS NOT NULL GROUP BY ALL),
   p AS (SELECT {by}, k / sum(k) OVER (PARTITION BY {by}) AS p FROM k)
   SELECT {by}, round({f}, 9) AS {name} FROM p GROUP BY ALL"""


@query(
    "A7_entropy",
    MEASURE_SQL.format(by="o_orderpriority", v="nullif(o_orderstatus, 'P')", t="orders", f="-sum(p * ln(p))", name="entropy"),
)
def entropy(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("v"))
    return rounded(class_measures(orders, "v", ["o_orderpriority"]).drop("gini"), 9)


@query(
    "A8_gini_impurity",
    MEASURE_SQL.format(by="user_id", v="nullif(event_type, 'view')", t="events", f="sum(p * (1 - p))", name="gini"),
)
def gini(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.nullif("event_type", F.lit("view")).alias("v"))
    return rounded(class_measures(ev, "v", ["user_id"]).drop("entropy"), 9)


@query(
    "A9_ranges",
    """SELECT 'o_totalprice' AS feature, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
       UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM orders""",
)
def column_ranges(spark, sf):
    return ranges(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@query(
    "A10_null_counts",
    """SELECT 'l_quantity' AS feature, count(*) FILTER (l_quantity = 7) AS n_null FROM lineitem
       UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount = 0) FROM lineitem
       UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag = 'N') FROM lineitem
       UNION ALL SELECT 'l_tax', 0""",
)
def nulls(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), "l_tax",
    )
    return null_counts(li)


@query(
    "A11_length_histogram",
    "SELECT CAST(length(text) AS INTEGER) AS length, count(*) AS n FROM documents GROUP BY 1",
)
def lengths(spark, sf):
    return length_histogram(table(spark, sf, "documents"), "text")


@query(
    "A12_outlier_flags",
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents)
       SELECT doc_id, n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a) AS is_outlier FROM documents, q""",
)
def outliers(spark, sf):
    return flag_outliers(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars").drop("n_chars")


@query(
    "A12_outlier_fences",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
       f AS (SELECT a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper FROM q)
       SELECT round(lower, 6) AS lower, round(upper, 6) AS upper, count(*) FILTER (value < lower OR value > upper) AS n_outliers
       FROM events, f GROUP BY ALL""",
)
def outlier_limits(spark, sf):
    ev = table(spark, sf, "events")
    lower, upper = outlier_fences(ev, "value")
    v = number("value")
    return rounded(ev.agg(F.count_if((v < lower) | (v > upper)).alias("n_outliers")).select(
        F.lit(lower).alias("lower"), F.lit(upper).alias("upper"), "n_outliers"))


BOX_SQL = """q AS (SELECT feature, label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
             FROM x GROUP BY ALL),
       f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
       SELECT feature, label, count(*) AS n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
              round(min(v) FILTER (v >= lower), 6) AS whisker_low, round(max(v) FILTER (v <= upper), 6) AS whisker_high,
              count(*) FILTER (v < lower OR v > upper) AS n_outliers
       FROM x JOIN f USING (feature, label) GROUP BY feature, label, q1, median, q3"""


@query(
    "A13_box_many_labels",
    "WITH x AS (SELECT 'l_quantity' AS feature, l_partkey AS label, CAST(l_quantity AS DOUBLE) AS v FROM lineitem), " + BOX_SQL,
)
def boxes_many(spark, sf):
    return rounded(box_summary(table(spark, sf, "lineitem"), ["l_quantity"], "l_partkey"))


@query(
    "A13_box_summary",
    """WITH x AS (SELECT 'value' AS feature, event_type AS label, value AS v FROM events
                  UNION ALL SELECT 'squared', event_type, value * value FROM events), """ + BOX_SQL,
)
def boxes(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "value", (F.col("value") * F.col("value")).alias("squared"))
    return rounded(box_summary(ev, ["value", "squared"], "event_type"))


@query(
    "A14_category_profiles",
    """WITH x AS (SELECT 'o_orderpriority' AS feature, coalesce(nullif(o_orderpriority, '1-URGENT'), 'missing') AS category, o_totalprice > 250000 AS y FROM orders
                  UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice > 250000 FROM orders)
       SELECT feature, category, count(*) AS sum, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n,
              round(count(*) FILTER (y) / count(*), 6) AS pr, round(count(*) FILTER (NOT y) / count(*), 6) AS nr,
              round((SELECT avg(CAST(o_totalprice > 250000 AS INTEGER)) FROM orders), 6) AS overall_pr
       FROM x GROUP BY ALL""",
)
def profiles(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), "o_orderstatus",
        (F.col("o_totalprice") > 250000).cast("int").alias("label"),
    )
    return rounded(category_profiles(orders, ["o_orderpriority", "o_orderstatus"], "label"))


@query(
    "A15_plot_series",
    """WITH g AS (SELECT l_linenumber AS bin, count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS p,
                         count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
       t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM g)
       SELECT bin, round(100 * ln((p / tp) / (n / tn)), 6) AS woe_pct, round(100 * p / c, 6) AS bad_rate_pct, c AS count FROM g, t""",
)
def series(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber", flag("l_returnflag", "R").alias("label"))
    return rounded(plot_series(woe_table(li, "label", "l_linenumber")))
