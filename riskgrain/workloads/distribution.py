"""Calendar, histogram, streak and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.calendar import daily_counts, daily_cumulative, monthly_counts, monthly_cumulative
from ..operators.edges import explicit
from ..operators.profile import density_curve, histograms, step_distribution
from ..operators.ranking import top
from ..operators.streaks import streaks
from ..operators.variable import analyse_features, feature_iv
from ..session import scratch_path
from ..sources.delimited import GB18030, read_delimited, write_delimited
from .binning import WIDE_EDGES, returned, wide_sql
from .registry import query, rounded, table

DAYS_SQL = """WITH d AS (SELECT CAST({c} AS DATE) AS day, count(*) AS n FROM {t} GROUP BY 1),
   s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day),
   f AS (SELECT day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (day))"""
MONTHS_SQL = """WITH d AS (SELECT CAST(date_trunc('month', {c}) AS DATE) AS m, count(*) AS n FROM {t} GROUP BY 1),
   s AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM d), (SELECT max(m) FROM d), INTERVAL 1 MONTH)) AS DATE) AS m),
   f AS (SELECT CAST(year(m) * 100 + month(m) AS INTEGER) AS month, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (m))"""


@query("T1_daily_counts", DAYS_SQL.format(c="o_orderdate", t="orders") + " SELECT * FROM f")
def days(spark, sf):
    return daily_counts(table(spark, sf, "orders"), "o_orderdate")


@query("T1_daily_counts_with_times", DAYS_SQL.format(c="ts", t="events") + " SELECT * FROM f")
def days_with_times(spark, sf):
    return daily_counts(table(spark, sf, "events"), "ts")


@query(
    "T2_daily_cumulative",
    DAYS_SQL.format(c="o_orderdate", t="orders")
    + " SELECT day, n, CAST((SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) <= day) AS BIGINT) AS cumulative FROM f",
)
def days_cumulative(spark, sf):
    return daily_cumulative(table(spark, sf, "orders"), "o_orderdate")


@query(
    "T3_monthly_counts",
    MONTHS_SQL.format(c="o_orderdate", t="orders") + " SELECT * FROM f",
)
def months(spark, sf):
    return monthly_counts(table(spark, sf, "orders"), "o_orderdate")


@query(
    "T4_monthly_cumulative",
    MONTHS_SQL.format(c="o_orderdate", t="orders")
    + """ SELECT month, n, CAST((SELECT count(*) FROM orders WHERE year(o_orderdate) * 100 + month(o_orderdate) <= f.month) AS BIGINT)
          AS cumulative FROM f""",
)
def months_cumulative(spark, sf):
    return monthly_cumulative(table(spark, sf, "orders"), "o_orderdate")


@query(
    "T5_daily_export",
    DAYS_SQL.format(c="l_shipdate", t="lineitem") + " SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cumulative FROM f",
)
def export_days(spark, sf):
    path = scratch_path(spark, "daily-csv")
    write_delimited(daily_cumulative(table(spark, sf, "lineitem"), "l_shipdate"), path, charset=GB18030, key="day")
    return read_delimited(spark, path, "day date, n bigint, cumulative bigint", charset=GB18030)


@query(
    "T5_monthly_export",
    MONTHS_SQL.format(c="ts", t="events") + " SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS cumulative FROM f",
)
def export_months(spark, sf):
    path = scratch_path(spark, "monthly-csv")
    write_delimited(monthly_cumulative(table(spark, sf, "events"), "ts"), path, charset=GB18030, key="month")
    return read_delimited(spark, path, "month int, n bigint, cumulative bigint", charset=GB18030)


@query(
    "T6_step_distribution",
    """WITH s AS (SELECT CAST(i AS DOUBLE) AS p FROM range((SELECT min(p_size) FROM part), (SELECT max(p_size) + 1 FROM part)) t(i))
       SELECT p, (SELECT count(*) FROM part WHERE p_size <= p AND (p_size > p - 1 OR p = (SELECT min(p) FROM s))) AS n,
              (SELECT count(*) FROM part WHERE p_size <= p) AS cumulative FROM s""",
)
def steps(spark, sf):
    return step_distribution(table(spark, sf, "part"), "p_size")


@query(
    "T6_step_distribution_limits",
    """WITH s AS (SELECT i + 0.5 AS p FROM range(3, 60) t(i))
       SELECT CAST(p AS DOUBLE) AS p, (SELECT count(*) FROM events WHERE value <= p AND (value > p - 1 OR p = 3.5)) AS n,
              (SELECT count(*) FROM events WHERE value <= p) AS cumulative FROM s""",
)
def limited_steps(spark, sf):
    return step_distribution(table(spark, sf, "events"), "value", 3.5, 60.0)


HISTOGRAM_SQL = """WITH x AS ({rows}),
   r AS (SELECT feature, min(v) AS lo, max(v) AS hi, greatest({bins}, count(DISTINCT v)) AS k, count(*) AS total FROM x GROUP BY feature),
   w AS (SELECT *, (hi - lo) / k AS width FROM r),
   b AS (SELECT x.feature, CAST(least(floor((v - lo) / width), k - 1) AS BIGINT) AS bin_id, lo, width, k, total FROM x JOIN w USING (feature))
   SELECT feature, bin_id, CAST(k AS BIGINT) AS n_bins, round(lo + bin_id * width, 6) + 0.0 AS "left",
          round(lo + (bin_id + 1) * width, 6) AS "right", count(*) AS n{density}
   FROM b GROUP BY feature, bin_id, lo, width, k, total"""


@query(
    "T7_histograms",
    HISTOGRAM_SQL.format(
        rows="""SELECT 'l_discount' AS feature, l_discount + 0.0 AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem
                UNION ALL SELECT 'l_tax', l_tax + 0.0 FROM lineitem""", bins=20, density="",
    ),
)
def feature_histograms(spark, sf):
    return rounded(histograms(table(spark, sf, "lineitem"), ["l_discount", "l_quantity", "l_tax"]))


@query(
    "T8_density",
    HISTOGRAM_SQL.format(
        rows="SELECT 'c_acctbal' AS feature, c_acctbal AS v FROM customer", bins=50,
        density=", round(count(*) / (total * width), 6) AS density",
    ),
)
def density(spark, sf):
    return rounded(histograms(table(spark, sf, "customer"), ["c_acctbal"], bins=50, density=True))


# kernels summed over all rows at each point
CURVE_SQL = """WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
   s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi,
     1.059::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349::DOUBLE) / pow(count(*), 0.2::DOUBLE) AS h FROM v),
   p AS (SELECT i, n, h, lo - 3 * h + i * (hi - lo + 6 * h) / 99 AS x FROM s, range(100) t(i))
   SELECT CAST(i AS INTEGER) AS point, round(x, 6) AS x, round(1000 * sum(exp(-pow((v - x) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 6) AS density
   FROM p, v GROUP BY i, n, h, x"""


@query("T8_density_curve", CURVE_SQL)
def curve(spark, sf):
    found = density_curve(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(found.withColumn("density", 1000 * F.col("density")))


STREAK_SQL = """WITH o AS (SELECT {e} AS e, {t} AS t, {hit} AS hit FROM {src}),
   i AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY e ORDER BY t) AS island FROM o),
   r AS (SELECT e, island, count(*) FILTER (hit) AS run FROM i GROUP BY ALL)
   SELECT e AS {e}, arg_max(run, island) AS current, max(run) AS longest FROM r GROUP BY e"""


@query("T9_streaks", STREAK_SQL.format(e="user_id", t="ts", hit="event_type IN ('view', 'click')", src="events"))
def user_streaks(spark, sf):
    return streaks(table(spark, sf, "events"), "user_id", "ts", F.col("event_type").isin("view", "click"))


@query(
    "T9_streaks_one_entity",
    """WITH o AS (SELECT 'all' AS e, o_orderkey AS t, o_totalprice > 100000 AS hit FROM orders),
       i AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY e ORDER BY t) AS island FROM o),
       r AS (SELECT e, island, count(*) FILTER (hit) AS run FROM i GROUP BY ALL)
       SELECT e AS entity_name, arg_max(run, island) AS current, max(run) AS longest FROM r GROUP BY e""",
)
def whole_table_streak(spark, sf):
    orders = table(spark, sf, "orders").withColumn("entity_name", F.lit("all"))
    return streaks(orders, "entity_name", "o_orderkey", F.col("o_totalprice") > 100000, chunk_rows=2000)


@query(
    "T10_best_feature",
    wide_sql() + """, f AS (SELECT feature, sum(iv) AS iv FROM i GROUP BY feature)
      SELECT feature, round(iv, 6) AS iv_total FROM f ORDER BY iv DESC, feature LIMIT 1""",
)
def best_feature(spark, sf):
    edges = {f: explicit(p) for f, p in WIDE_EDGES.items()}
    ivs = feature_iv(analyse_features(returned(spark, sf), edges, "y", smoothing="never"))
    return rounded(top(ivs.select("feature", "iv_total"), "iv_total", tie="feature"))


@query(
    "T10_best_per_group",
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def best_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top(orders, "o_totalprice", tie="o_orderkey", by=["o_orderpriority"])
