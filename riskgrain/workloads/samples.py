"""Sampling, splitting and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flag
from ..operators.recode import members, remaining, union_samples
from ..operators.resample import nearest_neighbours, synthetic_minority, undersample
from ..operators.sampling import random_split, stratified_folds, stratified_split
from .registry import query, rounded, table


@query(
    "S1_random_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || ':7')) AS n, count(*) OVER () AS t FROM events)
       SELECT event_id, CASE WHEN n <= ceil(0.25 * t) THEN 'test' WHEN n <= ceil(0.25 * t) + floor(0.5 * t) THEN 'train' END AS split
       FROM r""",
)
def by_fraction(spark, sf):
    ids = table(spark, sf, "events").select("event_id")
    return random_split(ids, "event_id", {"test": 0.25, "train": 0.5}, seed=7)


SIZES_SQL = """WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AS y, count(*) OVER () AS t,
                count(*) FILTER (o_orderstatus <> 'F') OVER () / count(*) OVER () AS rate FROM orders),
   s AS (SELECT *, CAST(floor(t * 0.2) AS BIGINT) AS a, CAST(floor(t * 0.5) AS BIGINT) AS b, CAST(floor(t * 0.1) AS BIGINT) AS c,
                row_number() OVER (PARTITION BY y ORDER BY md5(o_orderkey || ':11')) AS n FROM o),
   k AS (SELECT *, greatest(1, floor(a * rate)) AS na, greatest(1, floor(b * rate)) AS nb, greatest(1, floor(c * rate)) AS nc FROM s),
   z AS (SELECT *, CASE WHEN y THEN a - na ELSE na END AS wa, CASE WHEN y THEN b - nb ELSE nb END AS wb,
                CASE WHEN y THEN c - nc ELSE nc END AS wc FROM k),
   f AS (SELECT o_orderkey, y, CASE WHEN n <= wa THEN 'test' WHEN n <= wa + wb THEN 'train' WHEN n <= wa + wb + wc THEN 'val' END AS split FROM z)"""


def sized_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", flag("o_orderstatus", "F").alias("y"))
    n = orders.count()
    sizes = {"test": n * 2 // 10, "train": n * 5 // 10, "val": n // 10}
    return stratified_split(orders, "o_orderkey", "y", sizes, seed=11)


@query("S2_stratified_sizes", SIZES_SQL + " SELECT o_orderkey, split FROM f")
def by_size(spark, sf):
    return sized_split(spark, sf).select("o_orderkey", "split")


@query(
    "S3_stratified_folds",
    """SELECT event_id, CAST(ntile(10) OVER (PARTITION BY event_type ORDER BY md5(event_id || ':5')) - 1 AS INTEGER) AS fold FROM events""",
)
def folds(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return stratified_folds(ev, "event_id", "event_type", 10, seed=5).drop("event_type")


@query(
    "S3_many_label_folds",
    """SELECT l_orderkey, l_linenumber, CAST(ntile(3) OVER (PARTITION BY l_partkey ORDER BY md5(l_orderkey || ':' || l_linenumber || ':5')) - 1 AS INTEGER) AS fold
       FROM lineitem""",
)
def many_folds(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line"))
    return stratified_folds(lines, "line", "l_partkey", 3, seed=5).drop("l_partkey", "line")


UNDER_SQL = """WITH m AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5(o_orderkey || ':7')) AS n FROM orders WHERE o_orderpriority <> '5-LOW'),
   s AS (SELECT (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') AS p, (SELECT count(*) FROM m) AS t),"""


@query(
    "S4_undersample_with_replacement",
    UNDER_SQL
    + """ d AS (SELECT CAST('0x' || substr(md5(i || ':7'), 1, 13) AS BIGINT) % t + 1 AS n
                FROM s, (SELECT unnest(range((SELECT CAST(floor(p / 0.8) AS BIGINT) FROM s))) AS i))
       SELECT o_orderkey, o_totalprice, 0 AS y FROM d JOIN m USING (n)
       UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def drawn_again(spark, sf):
    return undersample(low_priority(spark, sf), "o_orderkey", "y", 0.8, seed=7)


@query(
    "S4_undersample_once",
    UNDER_SQL
    + """ d AS (SELECT o_orderkey, o_totalprice FROM m, s WHERE n <= floor(p / 0.5))
       SELECT *, 0 AS y FROM d UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def drawn_once(spark, sf):
    return undersample(low_priority(spark, sf), "o_orderkey", "y", 0.5, seed=7, replace=False)


def low_priority(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", flag("o_orderpriority", "5-LOW").alias("y"))


PAIR_SQL = """m AS (SELECT vec_id, embedding AS x FROM embeddings WHERE label = {label}),
   p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour,
                sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (CAST(t[1] AS DOUBLE) - t[2]) ^ 2))) AS distance
         FROM m a, m b WHERE a.vec_id <> b.vec_id),
   k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM p)"""


@query(
    "S5_nearest_neighbours",
    "WITH " + PAIR_SQL.replace("WHERE label = {label}", "")
    + " SELECT key, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM k WHERE rank <= 5",
)
def neighbours(spark, sf):
    return rounded(nearest_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 5))


@query(
    "S5_synthetic_minority",
    "WITH " + PAIR_SQL.format(label=0)
    + """, s AS (SELECT count(*) FILTER (label = 0) AS p, count(*) FILTER (label <> 0) AS t FROM embeddings),
       d AS (SELECT i AS draw, CAST('0x' || substr(md5(i || ':7'), 1, 13) AS BIGINT) % p + 1 AS position,
                    CAST('0x' || substr(md5(i || ':7'), 14, 13) AS BIGINT) % 5 + 1 AS rank,
                    CAST('0x' || substr(md5(i || ':8'), 1, 13) AS BIGINT) / 4503599627370496 AS step
             FROM s, (SELECT unnest(range((SELECT CAST(floor(0.5 * t) AS BIGINT) - p FROM s))) AS i)),
       b AS (SELECT vec_id, x, row_number() OVER (ORDER BY md5(vec_id || ':7')) AS position FROM m)
       SELECT draw, b.vec_id AS base, neighbour, round(step, 6) AS step, round(b.x[1] + step * (CAST(n.x[1] AS DOUBLE) - b.x[1]), 6) AS first_coordinate,
              round(list_sum(list_transform(list_zip(b.x, n.x), lambda t: t[1] + step * (CAST(t[2] AS DOUBLE) - t[1]))), 6) AS total
       FROM d JOIN b USING (position) JOIN k ON k.key = b.vec_id AND k.rank = d.rank JOIN m n ON n.vec_id = neighbour""",
)
def synthetic(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", flag("label", 0).alias("y"))
    made = synthetic_minority(rows, "vec_id", "embedding", "y", ratio=0.5, k=5, seed=7)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return rounded(made.select("draw", "base", "neighbour", "step", F.col("embedding")[0].alias("first_coordinate"), total.alias("total")))


@query("S6_union_of_samples", SIZES_SQL + " SELECT o_orderkey, y FROM (SELECT o_orderkey, CAST(y AS INTEGER) AS y, split FROM f) WHERE split IN ('train', 'val')")
def unioned(spark, sf):
    split = sized_split(spark, sf)
    parts = [split.where(F.col("split") == s).select("o_orderkey", "y") for s in ("train", "val")]
    return union_samples(*parts)


@query("S7_remaining_pool", SIZES_SQL + " SELECT o_orderkey FROM f WHERE split IS NULL OR split <> 'test'")
def pool(spark, sf):
    split = sized_split(spark, sf)
    return remaining(table(spark, sf, "orders").select("o_orderkey"), split.where("split = 'test'"), "o_orderkey")


@query(
    "S8_membership",
    """SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def membership(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0")
    return members(table(spark, sf, "documents").select("doc_id", "lang"), bad, "doc_id")
