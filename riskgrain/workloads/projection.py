"""Projection, filter and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flag, interval_ends, key_date, month_key, or_missing, shift_months
from ..operators.profile import ranges
from ..operators.recode import invert, pick_features, recode
from ..operators.response import category_response, display_names, pretty, woe_table
from .registry import query, rounded, table

PRIORITY_GROUPS = {
    "high": ["1-URGENT", "2-HIGH"], "mid": ["3-MEDIUM", "4-NOT SPECIFIED"], "low": ["5-LOW"],
}


@query("P1_keep_columns", "SELECT value, event_type FROM events")
def keep_columns(spark, sf):
    return table(spark, sf, "events").select("value", "event_type")


@query(
    "P2_drop_null_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL",
)
def drop_null_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return li.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).dropna(subset=["l_discount"])


@query(
    "P3_binary_response",
    """SELECT event_id, CAST(coalesce(event_type = 'purchase', false) AS INTEGER) AS y,
              CAST(coalesce(nullif(event_type, 'view') = 'click', false) AS INTEGER) AS y_null_is_zero
       FROM events""",
)
def binary_response(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", flag("event_type", "purchase").alias("y"),
        flag(F.nullif("event_type", F.lit("view")), "click").alias("y_null_is_zero"),
    )


@query(
    "P4_missing_category",
    "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'missing') AS priority FROM orders",
)
def missing_category(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(
        "o_orderkey", or_missing(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))).alias("priority")
    )


@query(
    "P5_pretty_table",
    """WITH g AS (
         SELECT coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'Missing') AS bin, count(*) AS c,
                count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus <> 'F') AS n
         FROM orders GROUP BY 1),
       t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM g),
       w AS (SELECT g.*, tp, tn, ln((p / tp) / (n / tn)) AS woe FROM g, t)
       SELECT bin, c AS "Count", format('{:.2f}%', 100.0 * c / (tp + tn)) AS "Total Distr", n AS "Goods",
              format('{:.2f}%', 100.0 * n / tn) AS "Distr Goods", p AS "Bads",
              format('{:.2f}%', 100.0 * p / tp) AS "Distr Bad", format('{:.2f}%', 100.0 * p / c) AS "Bad Rate",
              round(woe * 100, 3) AS "WOE", round((p / tp - n / tn) * woe, 6) AS "IV"
       FROM w""",
)
def pretty_table(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        flag("o_orderstatus", "F").alias("label"),
    )
    shown = pretty(woe_table(orders, "label", "priority", kind="c", smoothing="never"))
    return rounded(shown.drop("iv_total", "iv_finite"))


@query(
    "P5_display_names",
    """SELECT o_orderpriority AS category, count(*) AS "总人数", count(*) FILTER (o_orderstatus = 'F') AS "坏客户",
              count(*) FILTER (o_orderstatus <> 'F') AS "好客户",
              round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS "坏账率",
              round(count(*) FILTER (o_orderstatus <> 'F') / count(*), 6) AS "好账率",
              round((SELECT count(*) FILTER (o_orderstatus = 'F') / count(*) FROM orders), 6) AS "总坏账率"
       FROM orders GROUP BY 1""",
)
def shown_names(spark, sf):
    orders = table(spark, sf, "orders").withColumn("label", flag("o_orderstatus", "F"))
    return rounded(display_names(category_response(orders, "o_orderpriority", "label")))


@query(
    "P6_recode_validated",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
              WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'mid' ELSE 'low' END AS priority
       FROM orders""",
)
def recode_validated(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return recode(orders, "o_orderpriority", invert(PRIORITY_GROUPS), "priority").select("o_orderkey", "priority")


@query(
    "P7_features_by_type",
    """SELECT 'l_quantity' AS feature, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
       UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
       UNION ALL SELECT 'l_discount', min(l_discount + 0.0), max(l_discount) FROM lineitem""",
)
def features_by_type(spark, sf):
    li = table(spark, sf, "lineitem")
    info = spark.createDataFrame(
        [(n, "numerical" if t == "double" else "other") for n, t in li.dtypes], "feature string, feature_type string"
    )
    kept = pick_features(li, info, "numerical", exclude=["l_tax"])
    return ranges(li, kept)


@query(
    "P8_date_from_key",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS key_day,
              o_orderkey % 4 IN (0, 1) AS is_valid
       FROM orders""",
)
def date_from_key(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    tail = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    kind = F.col("o_orderkey") % 4
    key = (
        F.when(kind == 0, F.concat(F.lit("11000"), day, tail))
        .when(kind == 1, F.concat(day, tail))
        .when(kind == 2, F.concat(day, tail, F.lit("9")))
        .otherwise(F.concat(F.lit("1100000001399"), tail))
    )
    dated = table(spark, sf, "orders").select("o_orderkey", key_date(key).alias("key_day"))
    return dated.withColumn("is_valid", F.col("key_day").isNotNull())


@query(
    "P9_month_key",
    "SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month FROM orders",
)
def months(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", month_key("o_orderdate").alias("month"))


@query(
    "P10_shift_months",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month,
              CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS three_before
       FROM orders""",
)
def shifted(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", shift_months("o_orderdate", 1).alias("next_month"),
        shift_months("o_orderdate", -3).alias("three_before"),
    )


@query(
    "P11_interval_ends",
    """SELECT p_partkey, CASE WHEN p_size <= 40 THEN CAST(p_size // 10 AS DOUBLE) END AS lo,
              CAST(CASE WHEN p_size <= 40 THEN p_size // 10 + 1.5 END AS DOUBLE) AS hi
       FROM part""",
)
def ends_from_labels(spark, sf):
    tens = F.floor(F.col("p_size") / 10)
    label = F.when(
        F.col("p_size") <= 40, F.concat(F.lit("("), tens.cast("string"), F.lit(", "), (tens + 1.5).cast("string"), F.lit("]"))
    ).otherwise(F.lit("missing"))
    lo, hi = interval_ends(F.col("label"))
    return table(spark, sf, "part").select("p_partkey", label.alias("label")).select(
        "p_partkey", lo.alias("lo"), hi.cast("double").alias("hi")
    )
