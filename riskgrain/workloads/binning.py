"""Binning queries: breakpoints, assignment, buckets, tree and monotone bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flag
from ..operators.binning import assign_bins, bin_categorical, bin_numeric, even_buckets, monotone_bins
from ..operators.edges import Edges, even_depth, even_width, explicit, outer, value_range
from ..operators.response import with_ends
from ..operators.tree import breakpoints_by_depth, grow_tree, split_feature, tree_breakpoints
from ..operators.variable import VariableAnalysis, analyse_features, feature_iv
from .projection import PRIORITY_GROUPS
from .registry import query, rounded, table


def bin_counts(df, col, edges: Edges):
    """Rows per bin with the bin's ends."""
    counts = assign_bins(df, col, edges).groupBy(F.col("bin_id").alias("bin")).agg(F.count("*").alias("n"))
    return rounded(with_ends(counts, edges))


@query(
    "B1_equal_width_bins",
    """WITH r AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
       e AS (SELECT CAST(i AS INTEGER) AS bin, a + (b - a) * i / 10 AS lo,
                    CASE WHEN i = 9 THEN b ELSE a + (b - a) * (i + 1) / 10 END AS hi FROM r, range(10) t(i))
       SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n
       FROM e JOIN lineitem ON l_extendedprice <= hi AND (l_extendedprice > lo OR (bin = 0 AND l_extendedprice = lo))
       GROUP BY ALL""",
)
def equal_width(spark, sf):
    li = table(spark, sf, "lineitem")
    return bin_counts(li, "l_extendedprice", even_width(li, "l_extendedprice", 10))


@query(
    "B1_equal_width_rounded_edges",
    """WITH r AS (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b FROM supplier),
       p AS (SELECT i, CASE WHEN i = 0 THEN a - (b - a) * 0.001 WHEN i = 4 THEN b ELSE a + (b - a) * i / 4 END AS v
             FROM r, range(5) t(i)),
       e AS (SELECT CAST(x.i AS INTEGER) AS bin, round_even(x.v, 3) AS lo, round_even(y.v, 3) AS hi
             FROM p x JOIN p y ON y.i = x.i + 1)
       SELECT bin, lo, hi, count(*) AS n FROM e JOIN supplier ON s_acctbal > lo AND s_acctbal <= hi GROUP BY ALL""",
)
def equal_width_rounded(spark, sf):
    su = table(spark, sf, "supplier")
    return bin_counts(su, "s_acctbal", even_width(su, "s_acctbal", 4, precision=3))


@query(
    "B2_equal_depth_bins",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [i / 10 FOR i IN range(11)]) AS e FROM lineitem),
       b AS (SELECT CAST(i AS INTEGER) AS bin, e[i + 1] AS lo, e[i + 2] AS hi FROM q, range(10) t(i))
       SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n
       FROM b JOIN lineitem ON l_extendedprice <= hi AND (l_extendedprice > lo OR (bin = 0 AND l_extendedprice = lo))
       GROUP BY ALL""",
)
def equal_depth(spark, sf):
    li = table(spark, sf, "lineitem")
    return bin_counts(li, "l_extendedprice", even_depth(li, "l_extendedprice", 10))


@query(
    "B2_equal_depth_collapsed",
    """WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_discount + 0.0, [i / 20 FOR i IN range(21)]))) AS e
                  FROM lineitem),
       b AS (SELECT CAST(i AS INTEGER) AS bin, e[i + 1] AS lo, e[i + 2] AS hi FROM q, range(20) t(i)
             WHERE i + 2 <= len(e))
       SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n
       FROM b JOIN lineitem ON l_discount <= hi AND (l_discount > lo OR (bin = 0 AND l_discount = lo)) GROUP BY ALL""",
)
def equal_depth_collapsed(spark, sf):
    li = table(spark, sf, "lineitem")
    return bin_counts(li, "l_discount", even_depth(li, "l_discount", 20))


@query(
    "B3_explicit_intervals",
    """WITH e AS (SELECT * FROM (VALUES (0, 0.0, 10.0), (1, 10.0, 20.0), (2, 20.0, 50.0), (3, 50.0, 90.0)) t(bin_id, lo, hi))
       SELECT bin_id, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(p_size) AS n
       FROM e LEFT JOIN part ON p_size > lo AND p_size <= hi GROUP BY ALL""",
)
def explicit_intervals(spark, sf):
    edges = explicit([0, 10, 20, 50, 90], minimum=3)
    part = assign_bins(table(spark, sf, "part"), "p_size", edges)
    counts = part.groupBy("bin_id").agg(F.count("*").alias("n"))
    return edges.frame(part).join(counts, "bin_id", "left").fillna(0, ["n"])


@query(
    "B4_assign_explicit",
    """SELECT p_partkey, CASE WHEN p_size > 5 AND p_size <= 15 THEN 0 WHEN p_size > 15 AND p_size <= 30 THEN 1
              WHEN p_size > 30 AND p_size <= 45 THEN 2 ELSE -1 END AS bin_id FROM part""",
)
def assign_explicit(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return assign_bins(part, "p_size", [5, 15, 30, 45]).select("p_partkey", "bin_id")


def outer_sql(low: str, high: str) -> str:
    return f"""WITH r AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer),
       e AS (SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i = 0 THEN {low} ELSE a + (b - a) * i / 4 END AS lo,
                    CASE WHEN i = 3 THEN {high} ELSE a + (b - a) * (i + 1) / 4 END AS hi FROM r, range(4) t(i))
       SELECT coalesce(bin, -1) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n
       FROM customer LEFT JOIN e
         ON c_acctbal <= hi AND (c_acctbal > lo OR (bin = 0 AND c_acctbal = lo AND lo = (SELECT a FROM r)))
       GROUP BY ALL"""


OUTER_POLICIES = {
    "none": ({}, "a", "b"),
    "left_right": ({"left": 500.0, "right": 9000.0}, "500.0", "9000.0"),
    "inf": ({"edge": "inf", "left": 500.0}, "CAST('-inf' AS DOUBLE)", "CAST('inf' AS DOUBLE)"),
    "range": ({"edge": "range"}, "a - (b - a) * 0.005", "b + (b - a) * 0.005"),
}


def register_outer(policy: str) -> None:
    options, low, high = OUTER_POLICIES[policy]

    @query(f"B5_outer_edges_{policy}", outer_sql(low, high))
    def outer_edges(spark, sf):
        cu = table(spark, sf, "customer")
        edges = outer(even_width(cu, "c_acctbal", 4), span=value_range(cu, "c_acctbal"), **options)
        return bin_counts(cu, "c_acctbal", edges)


for _policy in OUTER_POLICIES:
    register_outer(_policy)


@query(
    "B6_missing_bin",
    """WITH x AS (SELECT nullif(l_discount, 0) AS v, l_returnflag = 'R' AS y FROM lineitem),
       r AS (SELECT min(v) AS a, max(v) AS b FROM x),
       e AS (SELECT CAST(i AS INTEGER) AS bin, a + (b - a) * i / 3 AS lo,
                    CASE WHEN i = 2 THEN b ELSE a + (b - a) * (i + 1) / 3 END AS hi FROM r, range(3) t(i))
       SELECT coalesce(bin, -1) AS bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count(*) AS n,
              count(*) FILTER (y) AS positive
       FROM x LEFT JOIN e ON v <= hi AND (v > lo OR (bin = 0 AND v = lo)) GROUP BY ALL""",
)
def missing_bin(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.nullif("l_discount", F.lit(0.0)).alias("v"), flag("l_returnflag", "R").alias("y")
    )
    binned, edges = bin_numeric(li, "v", 3)
    counts = binned.groupBy(F.col("bin_id").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("positive"))
    return rounded(with_ends(counts, edges))


@query("B7_categories", "SELECT p_type AS bin, count(*) AS n, round(avg(p_size), 6) AS mean_size FROM part GROUP BY 1")
def categories(spark, sf):
    part = bin_categorical(table(spark, sf, "part"), "p_type")
    return rounded(part.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p_size").alias("mean_size")))


@query(
    "B7_grouped_categories",
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                   WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'mid' ELSE 'low' END AS bin,
              count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1""",
)
def grouped_categories(spark, sf):
    orders = bin_categorical(table(spark, sf, "orders"), "o_orderpriority", PRIORITY_GROUPS)
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return orders.groupBy("bin").agg(F.count("*").alias("n"), F.round(price, 2).alias("price"))


@query("B8_even_buckets", "SELECT event_id, CAST(ntile(7) OVER (ORDER BY value, event_id) AS INTEGER) AS bucket FROM events")
def buckets(spark, sf):
    return even_buckets(table(spark, sf, "events"), "value", "event_id", 7).select("event_id", "bucket")


@query(
    "B8_even_buckets_many",
    """SELECT o_orderkey, CAST(ntile((SELECT CAST(count(*) // 10 AS BIGINT) FROM orders)) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS bucket
       FROM orders""",
)
def many_buckets(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return even_buckets(orders, "o_totalprice", "o_orderkey", orders.count() // 10).select("o_orderkey", "bucket")


@query(
    "B8_even_buckets_ties",
    """SELECT o_orderkey, CAST(ntile(11) OVER (ORDER BY year(o_orderdate), o_orderkey) AS INTEGER) AS bucket FROM orders""",
)
def buckets_with_ties(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return even_buckets(orders, "y", "o_orderkey", 11).select("o_orderkey", "bucket")


# --- tree -----------------------------------------------------------------

SCORES = {
    "woe": "abs(ln((lp / tp) / (ln_ / tn)) - ln((rp / tp) / (rn / tn)))",
    "iv": "(lp / tp - ln_ / tn) * ln((lp / tp) / (ln_ / tn)) + (rp / tp - rn / tn) * ln((rp / tp) / (rn / tn))",
    "gini": "-((2 * lp * ln_ / lc / lc) * lc / (lc + rc) + (2 * rp * rn / rc / rc) * rc / (lc + rc)) / 2",
    "entropy": """(-(lp + rp) / (lc + rc) * ln((lp + rp) / (lc + rc)) - (ln_ + rn) / (lc + rc) * ln((ln_ + rn) / (lc + rc)))
        - lc / (lc + rc) * (-lp / lc * ln(lp / lc) - ln_ / lc * ln(ln_ / lc))
        - rc / (lc + rc) * (-rp / rc * ln(rp / rc) - rn / rc * ln(rn / rc))""",
}
LEFT = {
    "woe": "ln((lp / tp) / (ln_ / tn))", "iv": "(lp / tp - ln_ / tn) * ln((lp / tp) / (ln_ / tn))",
    "gini": "2 * lp * ln_ / lc / lc", "entropy": "-lp / lc * ln(lp / lc) - ln_ / lc * ln(ln_ / lc)",
}
TREE_SOURCE = {
    "lineitem": """SELECT 'l_quantity' AS feature, l_quantity AS v, l_returnflag = 'R' AS y FROM lineitem
         UNION ALL SELECT 'l_discount', l_discount + 0.0, l_returnflag = 'R' FROM lineitem
         UNION ALL SELECT 'l_tax', l_tax + 0.0, l_returnflag = 'R' FROM lineitem""",
    "orders": "SELECT 'o_totalprice' AS feature, o_totalprice AS v, o_orderstatus = 'F' AS y FROM orders",
    "known": """SELECT 'l_quantity' AS feature, l_quantity AS v, l_returnflag = 'R' AS y FROM lineitem
         UNION ALL SELECT 'billed_tax', l_tax + 0.0, l_returnflag = 'R' FROM lineitem WHERE l_linestatus <> 'O'
         UNION ALL SELECT 'large_discount', l_discount + 0.0, l_returnflag = 'R' FROM lineitem WHERE l_quantity > 30""",
}


def level_sql(i: int, metric: str, min_split: int) -> str:
    """Best splits of level ``i`` and the nodes of level ``i + 1``."""
    right = LEFT[metric].replace("lp", "rp").replace("ln_", "rn").replace("lc", "rc")
    return f"""
    c{i} AS MATERIALIZED (SELECT n.*, h.v, sum(p) OVER w AS lp, sum(n0) OVER w AS ln_, sum(c) OVER w AS lc
           FROM n{i} n JOIN h ON h.feature = n.feature AND h.v > n.lo AND h.v <= n.hi
           WHERE size >= 4 AND positive > 0 AND negative > 0
           WINDOW w AS (PARTITION BY n.feature, n.node_id ORDER BY h.v)),
    d{i} AS MATERIALIZED (SELECT *, positive - lp AS rp, negative - ln_ AS rn, size - lc AS rc FROM c{i}),
    f{i} AS MATERIALIZED (SELECT * FROM d{i} WHERE lc >= {min_split} AND rc >= {min_split} AND lp > 0 AND ln_ > 0 AND rp > 0 AND rn > 0),
    s{i} AS MATERIALIZED (SELECT * FROM (SELECT *, {LEFT[metric]} AS lv, {right} AS rv, round({SCORES[metric]}, 12) AS score FROM f{i})
           QUALIFY row_number() OVER (PARTITION BY feature, node_id ORDER BY score DESC, v) = 1),
    n{i + 1} AS MATERIALIZED (SELECT feature, node_id * 2 AS node_id, node_id AS parent_id, depth + 1 AS depth, lo, v AS hi, lc AS size,
                    lp AS positive, ln_ AS negative, lv AS value, tp, tn FROM s{i}
            UNION ALL SELECT feature, node_id * 2 + 1, node_id, depth + 1, v, hi, rc, rp, rn, rv, tp, tn FROM s{i})"""


def tree_sql(source: str, metric: str, max_depth: int, min_split: str) -> str:
    """Level-by-level tree from its definition; ends with CTEs n1..n(d+1) and s1..sd."""
    levels = ",".join(level_sql(i, metric, min_split) for i in range(1, max_depth + 1))
    return f"""WITH x AS (SELECT feature, v, CAST(y AS INTEGER) AS y FROM ({TREE_SOURCE[source]})),
    h AS MATERIALIZED (SELECT feature, v, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n0, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY ALL),
    n1 AS MATERIALIZED (SELECT feature, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 1 AS depth,
                  CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, sum(c) AS size, sum(p) AS positive,
                  sum(n0) AS negative, CAST(NULL AS DOUBLE) AS value, sum(p) AS tp, sum(n0) AS tn FROM h GROUP BY feature),
    {levels}"""


def nodes_sql(max_depth: int) -> str:
    parts = [
        f"""SELECT n.feature, n.node_id, n.parent_id, CAST(n.depth AS INTEGER) AS depth, n.lo, n.hi,
               CAST(n.size AS BIGINT) AS size, CAST(n.positive AS BIGINT) AS positive,
               CAST(n.negative AS BIGINT) AS negative, round(n.value, 6) + 0.0 AS value, s.v AS bp, s.v IS NULL AS is_leaf
            FROM n{i} n LEFT JOIN s{i} s ON s.feature = n.feature AND s.node_id = n.node_id"""
        for i in range(1, max_depth + 1)
    ]
    parts.append(
        f"""SELECT feature, node_id, parent_id, CAST(depth AS INTEGER), lo, hi, CAST(size AS BIGINT), CAST(positive AS BIGINT),
               CAST(negative AS BIGINT), round(value, 6) + 0.0, CAST(NULL AS DOUBLE), true FROM n{max_depth + 1}"""
    )
    # nodes are numbered level by level, from low to high values
    return f""", t AS ({" UNION ALL ".join(parts)}),
        k AS (SELECT feature, node_id, row_number() OVER (PARTITION BY feature ORDER BY depth, lo) AS i FROM t)
        SELECT t.* REPLACE (k.i AS node_id, u.i AS parent_id) FROM t JOIN k ON k.feature = t.feature AND k.node_id = t.node_id
        LEFT JOIN k u ON u.feature = t.feature AND u.node_id = t.parent_id"""


FEATURES = ["l_quantity", "l_discount", "l_tax"]


def returned(spark, sf):
    return table(spark, sf, "lineitem").select(*FEATURES, flag("l_returnflag", "R").alias("y"))


def register_split(metric: str) -> None:
    sign = "-" if metric == "gini" else ""

    @query(
        f"B9_best_split_{metric}",
        tree_sql("lineitem", metric, 1, "50")
        + f""" SELECT feature, v AS bp, round({sign}score, 6) AS score, round(lv, 6) + 0.0 AS value_left,
                round(rv, 6) + 0.0 AS value_right, CAST(lc AS BIGINT) AS size_left, CAST(rc AS BIGINT) AS size_right FROM s1""",
    )
    def best_split(spark, sf):
        return rounded(split_feature(returned(spark, sf), FEATURES, "y", metric, min_split_size=50))


def register_tree(metric: str) -> None:
    @query(f"B10_tree_{metric}", tree_sql("lineitem", metric, 2, "100") + nodes_sql(2))
    def tree(spark, sf):
        return rounded(grow_tree(returned(spark, sf), FEATURES, "y", metric, max_depth=2, min_split_size=100))


for _metric in SCORES:
    register_split(_metric)
    register_tree(_metric)


@query(
    "B10_tree_many_values",
    tree_sql("orders", "iv", 3, "(SELECT floor(count(*) * 0.05) FROM orders)") + nodes_sql(3),
)
def tree_many_values(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", flag("o_orderstatus", "F").alias("y"))
    return rounded(grow_tree(orders, ["o_totalprice"], "y", "iv", max_depth=3, min_leaf_size=0.05, min_split_size=0.05))


# at least a tenth of the rows per leaf: ten leaves at most, so nine levels of splits
@query(
    "B10_tree_unlimited",
    tree_sql("orders", "entropy", 9, "(SELECT floor(count(*) * 0.1) FROM orders)") + nodes_sql(9),
)
def tree_unlimited(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", flag("o_orderstatus", "F").alias("y"))
    return rounded(grow_tree(orders, ["o_totalprice"], "y", "entropy", min_split_size=0.1))


@query(
    "B10_tree_fractions_with_nulls",
    tree_sql("known", "entropy", 3, "floor((tp + tn) * 0.08)") + nodes_sql(3),
)
def tree_fractions(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_quantity", F.when(F.col("l_linestatus") != "O", F.col("l_tax")).alias("billed_tax"),
        F.when(F.col("l_quantity") > 30, F.col("l_discount")).alias("large_discount"), flag("l_returnflag", "R").alias("y"))
    features = ["l_quantity", "billed_tax", "large_discount"]
    return rounded(grow_tree(rows, features, "y", "entropy", max_depth=3, min_leaf_size=0.08, min_split_size=0.08))


@query(
    "B11_tree_breakpoints",
    tree_sql("lineitem", "entropy", 2, "100")
    + """ SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY v) AS INTEGER) AS position, v AS bp
          FROM (SELECT feature, v FROM s1 UNION ALL SELECT feature, v FROM s2)""",
)
def tree_points(spark, sf):
    nodes = grow_tree(returned(spark, sf), FEATURES, "y", "entropy", max_depth=2, min_split_size=100)
    return tree_breakpoints(nodes).select("feature", F.posexplode("breakpoints").alias("p", "bp")).select(
        "feature", (F.col("p") + 1).alias("position"), "bp"
    )


@query(
    "B12_breakpoints_by_depth",
    tree_sql("lineitem", "gini", 2, "100")
    + """ SELECT feature, CAST(depth AS INTEGER) AS depth, coalesce(array_to_string(list_sort(list(v) FILTER (v IS NOT NULL)), '|'), '') AS breakpoints
          FROM (SELECT feature, depth, v FROM s1 UNION ALL SELECT feature, depth, v FROM s2
                UNION ALL SELECT DISTINCT feature, 3, CAST(NULL AS DOUBLE) FROM n3) GROUP BY ALL""",
)
def points_by_depth(spark, sf):
    nodes = grow_tree(returned(spark, sf), FEATURES, "y", "gini", max_depth=2, min_split_size=100)
    levels = breakpoints_by_depth(nodes)
    return levels.select("feature", "depth", F.array_join(F.col("breakpoints").cast("array<string>"), "|").alias("breakpoints"))


MONOTONE_SQL = """
WITH m AS (SELECT median(v) AS med FROM (SELECT nullif({v}, {null}) AS v FROM {t})),
x AS MATERIALIZED (SELECT coalesce(nullif({v}, {null}), med) AS x, CAST({y} AS INTEGER) AS y FROM {t}, m),
e AS MATERIALIZED ({edges}),
b AS MATERIALIZED (SELECT n, CAST(i - 1 AS INTEGER) AS bin_id, e[i] AS lo, e[i + 1] AS hi FROM e, range(1, 20) t(i) WHERE i < len(e)),
g AS (SELECT n, bin_id, min(x) AS min_x, max(x) AS max_x, sum(y) AS sum_y, count(*) AS total, avg(y) AS rate, avg(x) AS mean_x
      FROM b JOIN x ON x <= hi AND (x > lo OR (bin_id = 0 AND x = lo)) GROUP BY ALL),
r AS (SELECT n, rank() OVER (PARTITION BY n ORDER BY mean_x) + (count(*) OVER (PARTITION BY n, mean_x) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY n ORDER BY rate) + (count(*) OVER (PARTITION BY n, rate) - 1) / 2 AS ry FROM g),
j AS (SELECT n FROM r GROUP BY n HAVING count(*) = 1 OR abs(corr(rx, ry)) > 1 - 1e-9)
SELECT bin_id, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, CAST(sum_y AS DOUBLE) AS sum_y, total, round(rate, 6) AS rate
FROM g WHERE n = (SELECT max(n) FROM j)"""
MONOTONE_EDGES = " UNION ALL ".join(
    f"SELECT {n} AS n, list_sort(list_distinct(quantile_cont(x, [i / {n} FOR i IN range({n + 1})]))) AS e FROM x"
    for n in range(2, 21)
)


@query(
    "B13_monotone_bins",
    MONOTONE_SQL.format(v="l_quantity", null="7", t="lineitem", y="l_returnflag = 'R'", edges=MONOTONE_EDGES),
)
def monotone(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.nullif("l_quantity", F.lit(7.0)).alias("q"), flag("l_returnflag", "R").alias("y")
    )
    return rounded(monotone_bins(li, "q", "y")[1])


@query(
    "B13_monotone_bins_trend",
    MONOTONE_SQL.format(
        v="p_retailprice", null="900", t="part", y="p_partkey % 97 < p_retailprice / 25 - 20", edges=MONOTONE_EDGES
    ),
)
def monotone_trend(spark, sf):
    part = table(spark, sf, "part").select(
        F.nullif("p_retailprice", F.lit(900.0)).alias("x"),
        (F.col("p_partkey") % 97 < F.col("p_retailprice") / 25 - 20).cast("int").alias("y"),
    )
    return rounded(monotone_bins(part, "x", "y")[1])


WIDE_EDGES = {"l_quantity": [0, 10, 25, 50], "l_discount": [-0.01, 0.02, 0.06, 0.1], "l_tax": [-0.01, 0.03, 0.08]}


def wide_sql() -> str:
    cases = []
    for f, points in WIDE_EDGES.items():
        tests = " ".join(
            f"WHEN {f} > {a} AND {f} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(points, points[1:]))
        )
        cases.append(f"SELECT '{f}' AS feature, CASE {tests} ELSE -1 END AS bin, l_returnflag = 'R' AS y FROM lineitem")
    return f"""WITH x AS ({' UNION ALL '.join(cases)}),
       g AS (SELECT feature, bin, count(*) AS count, count(*) FILTER (y) AS positive, count(*) FILTER (NOT y) AS negative
             FROM x GROUP BY ALL),
       t AS (SELECT feature, sum(positive) AS tp, sum(negative) AS tn FROM g GROUP BY feature),
       w AS (SELECT g.*, tp, tn, ln((positive / tp) / (negative / tn)) AS woe FROM g JOIN t USING (feature)),
       i AS (SELECT *, (positive / tp - negative / tn) * woe AS iv FROM w)"""


def wide_table(spark, sf):
    edges = {f: explicit(p) for f, p in WIDE_EDGES.items()}
    return analyse_features(returned(spark, sf), edges, "y", smoothing="never")


@query(
    "B14_many_features",
    wide_sql()
    + """ SELECT feature, bin, count, positive, negative, round(positive / count, 6) AS bad_rate, round(woe, 6) AS woe,
                 round(iv, 6) AS iv FROM i""",
)
def many_features(spark, sf):
    return rounded(wide_table(spark, sf).select("feature", "bin", "count", "positive", "negative", "bad_rate", "woe", "iv"))


@query(
    "B14_feature_iv",
    wide_sql() + " SELECT feature, round(sum(iv), 6) AS iv_total, round(sum(iv), 6) AS iv_finite FROM i GROUP BY feature",
)
def iv_per_feature(spark, sf):
    return rounded(feature_iv(wide_table(spark, sf)))


@query(
    "B14_variable_analysis",
    """WITH q AS (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS e FROM customer),
       x AS (SELECT CAST(len(list_filter(e, lambda p: p < c_acctbal)) AS INTEGER) AS bin, c_mktsegment = 'BUILDING' AS y, e
             FROM customer, q),
       g AS (SELECT bin, count(*) AS count, count(*) FILTER (y) AS positive, count(*) FILTER (NOT y) AS negative,
                    CASE WHEN bin = 0 THEN CAST('-inf' AS DOUBLE) ELSE any_value(e)[bin] END AS lo,
                    CASE WHEN bin = 4 THEN CAST('inf' AS DOUBLE) ELSE any_value(e)[bin + 1] END AS hi FROM x GROUP BY bin),
       w AS (SELECT *, ln((positive / (sum(positive) OVER ())) / (negative / (sum(negative) OVER ()))) AS woe FROM g)
       SELECT bin, count, positive, negative, round(lo, 6) AS lo, round(hi, 6) AS hi, round(woe, 6) AS woe FROM w""",
)
def variable_analysis(spark, sf):
    cu = table(spark, sf, "customer").withColumn("y", flag("c_mktsegment", "BUILDING"))
    analysis = VariableAnalysis(cu, "c_acctbal", label="y")
    analysis.find_breakpoints("even_depth", n=5, edge="inf")
    return rounded(analysis.stats().select("bin", "count", "positive", "negative", "lo", "hi", "woe"))


@query(
    "B14_tree_method",
    tree_sql("orders", "woe", 2, "(SELECT floor(count(*) * 0.1) FROM orders)")
    + """, k AS (SELECT list_sort(list(v)) AS e FROM (SELECT v FROM s1 UNION ALL SELECT v FROM s2)),
          z AS (SELECT CAST(len(list_filter(e, lambda p: p < o_totalprice)) AS INTEGER) AS bin, o_orderstatus = 'F' AS y FROM orders, k),
          q AS (SELECT bin, count(*) AS count, count(*) FILTER (y) AS positive FROM z GROUP BY bin)
          SELECT *, round(positive / count, 6) AS bad_rate FROM q""",
)
def tree_method(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", flag("o_orderstatus", "F"))
    analysis = VariableAnalysis(orders, "o_totalprice", label="y")
    analysis.find_breakpoints("woe", edge="inf", max_depth=2, min_leaf_size=0.1, min_split_size=0.1)
    return rounded(analysis.stats().select("bin", "count", "positive", "bad_rate"))
