"""Enrichment queries and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ellipsoid_km
from ..operators.closest import resolve_closest
from ..operators.enrich import (
    attach_label, distances, next_batch, pending, resolve, run_batch, stored_results,
)
from ..session import materialise, scratch_path
from ..streaming.jobs import daily_stream, enrich_stream
from .registry import query, rounded, table

PLACES_SQL = """places AS (SELECT n_name AS address, n_nationkey * 3.5 - 40 AS lat, n_nationkey * 7.0 - 90 AS lon FROM nation WHERE n_nationkey < 22),
   rows_ AS (SELECT c_custkey, h.n_name AS home, w.n_name AS work FROM customer JOIN nation h ON h.n_nationkey = c_nationkey
             LEFT JOIN nation w ON w.n_nationkey = (c_nationkey * 3 + c_custkey) % 28)"""


def gazetteer(spark, sf):
    nation = table(spark, sf, "nation").where("n_nationkey < 22")
    return nation.select(
        F.col("n_name").alias("address"), (F.col("n_nationkey") * 3.5 - 40).cast("double").alias("lat"),
        (F.col("n_nationkey") * 7.0 - 90).cast("double").alias("lon"),
    )


def addressed(spark, sf):
    """Customers with two address fields, some unknown to the gazetteer or missing."""
    nation = table(spark, sf, "nation")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home"))
    work = nation.select(F.col("n_nationkey").cast("bigint").alias("_w"), F.col("n_name").alias("work"))
    cu = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    cu = cu.withColumn("_w", (F.col("c_nationkey") * 3 + F.col("c_custkey")) % 28)
    return cu.join(home, "c_nationkey").join(work, "_w", "left").select("c_custkey", "home", "work")


def finished(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").where(key % 3 == 0).select(
        "c_custkey", F.when(key % 2 == 0, 1.5).alias("home_lat")
    )


@query("G1_pending_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0")
def not_done(spark, sf):
    return pending(table(spark, sf, "customer").select("c_custkey", "c_name"), finished(spark, sf), "c_custkey")


@query("G1_pending_with_retry", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 <> 0")
def not_done_or_failed(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return pending(customers, finished(spark, sf), "c_custkey", retry_failed=["home_lat"])


@query("G2_next_batch", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_custkey LIMIT 70")
def batch(spark, sf):
    return next_batch(not_done(spark, sf), "c_custkey", 70)


RESOLVED_SQL = f"""WITH {PLACES_SQL}, resolved AS (SELECT r.*, h.lat AS home_lat, h.lon AS home_lon, w.lat AS work_lat, w.lon AS work_lon
   FROM rows_ r LEFT JOIN places h ON h.address = home LEFT JOIN places w ON w.address = work)"""


@query(
    "G3_resolve_addresses",
    RESOLVED_SQL + """ SELECT c_custkey, home, work, CAST(home_lat AS DOUBLE) AS home_lat, CAST(home_lon AS DOUBLE) AS home_lon,
        CAST(work_lat AS DOUBLE) AS work_lat, CAST(work_lon AS DOUBLE) AS work_lon FROM resolved""",
)
def coordinates(spark, sf):
    return resolve(addressed(spark, sf), "c_custkey", ["home", "work"], gazetteer(spark, sf))


@query(
    "G3_duplicate_places",
    """WITH places AS (SELECT n_name AS address, s_acctbal AS lat, s_suppkey AS lon, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal, s_suppkey) AS i
                       FROM supplier JOIN nation ON n_nationkey = s_nationkey)
       SELECT c_custkey, n_name AS home, CAST(lat AS DOUBLE) AS home_lat, CAST(lon AS DOUBLE) AS home_lon
       FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN places ON address = n_name AND i = 1""",
)
def duplicate_places(spark, sf):
    nation = table(spark, sf, "nation")
    places = table(spark, sf, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("address"), F.col("s_acctbal").cast("double").alias("lat"), F.col("s_suppkey").cast("double").alias("lon"))
    homes = table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.col("n_name").alias("home"))
    return resolve(homes, "c_custkey", ["home"], places)


# beginnings of documents as addresses; those looked up hold up to three edits
TYPED_SQL = """clean AS (SELECT doc_id, substr(regexp_replace(text, '[^ -~]', '', 'g'), 1, 4 + doc_id % 37) AS address FROM documents),
   places AS (SELECT address, min(struct_pack(lat := doc_id * 0.25, lon := doc_id * 0.5)) AS at FROM clean
              WHERE doc_id % 3 <> 0 AND address IS NOT NULL GROUP BY address),
   typed AS (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN substr(address, 1, 2) || substr(address, 4) WHEN 2 THEN substr(address, 1, 3) || '#' || substr(address, 5)
      WHEN 3 THEN substr(address, 1, 1) || 'zz' || substr(address, 2) WHEN 4 THEN address || 'qqq'
      WHEN 5 THEN substr(address, 2, length(address) - 2) ELSE address END AS home FROM clean)"""


def typed_addresses(spark, sf):
    """``(doc_id, home)`` with typing errors, and the gazetteer of the right spellings."""
    clean = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("text")).select(
        "doc_id", F.substring("text", F.lit(1), (4 + F.col("doc_id") % 37).cast("int")).alias("address"))
    # whole texts are cleaned once, what is left of them is short
    clean = materialise(clean, "addresses")

    def part(start: int, length=None):
        return F.substring("address", F.lit(start), F.lit(length) if isinstance(length, int) else F.length("address") if length is None else length)

    kind = F.col("doc_id") % 6
    home = (
        F.when(kind == 1, F.concat(part(1, 2), part(4))).when(kind == 2, F.concat(part(1, 3), F.lit("#"), part(5)))
        .when(kind == 3, F.concat(part(1, 1), F.lit("zz"), part(2))).when(kind == 4, F.concat("address", F.lit("qqq")))
        .when(kind == 5, part(2, F.length("address") - 2)).otherwise(F.col("address")))
    places = clean.where("doc_id % 3 <> 0").select(
        "address", (F.col("doc_id") * 0.25).alias("lat"), (F.col("doc_id") * 0.5).alias("lon"))
    return clean.select("doc_id", home.alias("home")), places


@query(
    "G3_closest_addresses",
    f"""WITH {TYPED_SQL}, pair AS (SELECT home, p.address, at, levenshtein(home, p.address) AS edits
       FROM (SELECT DISTINCT home FROM typed) JOIN places p ON abs(length(home) - length(p.address)) <= 2),
   best AS (SELECT * FROM pair WHERE edits <= 2 QUALIFY row_number() OVER (PARTITION BY home ORDER BY edits, address) = 1)
   SELECT doc_id, t.home, address AS home_match, CAST(edits AS INTEGER) AS home_edits, CAST(at.lat AS DOUBLE) AS home_lat,
      CAST(at.lon AS DOUBLE) AS home_lon FROM typed t LEFT JOIN best b ON b.home = t.home""",
)
def closest_addresses(spark, sf):
    rows, places = typed_addresses(spark, sf)
    return resolve_closest(rows, ["home"], places)


@query("G4_attach_label", "SELECT d.doc_id, lang, quality AS label FROM documents d LEFT JOIN labels USING (doc_id)")
def labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return attach_label(table(spark, sf, "documents").select("doc_id", "lang"), labels, "doc_id")


@query(
    "G5_batch_progress",
    "SELECT least(100, count(*)) AS extracted, greatest(count(*) - 140, 0) AS remaining, count(*) AS total FROM customer",
)
def progress(spark, sf):
    path = scratch_path(spark, "resolved")
    rows, places = addressed(spark, sf), gazetteer(spark, sf)
    run_batch(rows, "c_custkey", ["home", "work"], places, path, 40)
    return run_batch(rows, "c_custkey", ["home", "work"], places, path, 100)


@query(
    "G5_appended_results",
    RESOLVED_SQL + """ SELECT c_custkey, CAST(home_lat AS DOUBLE) AS home_lat, CAST(work_lon AS DOUBLE) AS work_lon,
        CAST(c_custkey % 2 AS INTEGER) AS label FROM resolved""",
)
def appended(spark, sf):
    path = scratch_path(spark, "resolved")
    rows, places = addressed(spark, sf), gazetteer(spark, sf)
    labels = rows.select("c_custkey", (F.col("c_custkey") % 2).cast("int").alias("label"))
    total = rows.count()
    for amount in (total // 2, total):
        run_batch(rows, "c_custkey", ["home", "work"], places, path, amount, labels)
    return stored_results(spark, path).select("c_custkey", "home_lat", "work_lon", "label")


@query(
    "G6_distances",
    RESOLVED_SQL + """ SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(work_lat - home_lat) / 2), 2)
        + cos(radians(home_lat)) * cos(radians(work_lat)) * pow(sin(radians(work_lon - home_lon) / 2), 2))), 6) AS "home-work"
        FROM resolved""",
)
def apart(spark, sf):
    resolved = distances(coordinates(spark, sf), ["home", "work"])
    return rounded(resolved.select("c_custkey", "home-work"))


# the iteration step by step, then the length; points that do not settle get the great circle
ELLIPSOID_SQL = RESOLVED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
   k AS (SELECT 6378.137::DOUBLE AS a, 6356.752314245::DOUBLE AS b, (6378.137::DOUBLE - 6356.752314245::DOUBLE) / 6378.137::DOUBLE AS f),
   q AS MATERIALIZED (SELECT DISTINCT home_lat::DOUBLE AS y1, home_lon::DOUBLE AS x1, work_lat::DOUBLE AS y2, work_lon::DOUBLE AS x2 FROM resolved
         WHERE home_lat IS NOT NULL AND work_lat IS NOT NULL),
   z AS (SELECT *, atan((1 - f) * tan(radians(y1))) AS u1, atan((1 - f) * tan(radians(y2))) AS u2, radians(x2 - x1) AS gap FROM q, k),
   walk AS (
     SELECT 0 AS step, z.*, gap AS lon, 0.0::DOUBLE AS arc, 0.0::DOUBLE AS sn, 0.0::DOUBLE AS cs, 0.0::DOUBLE AS sq, 0.0::DOUBLE AS mid, 0.0::DOUBLE AS moved FROM z
     UNION ALL
     SELECT step + 1, y1, x1, y2, x2, a, b, f, u1, u2, gap, gap + (1 - c) * f * bear * (arc + c * sn * (mid + c * cs * (2 * mid * mid - 1))),
       arc, sn, cs, sq, mid, abs(gap + (1 - c) * f * bear * (arc + c * sn * (mid + c * cs * (2 * mid * mid - 1))) - lon)
     FROM (SELECT *, f / 16 * sq * (4 + f * (4 - 3 * sq)) AS c FROM (
       SELECT *, CASE WHEN sq <= 1e-15 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / sq END AS mid FROM (
         SELECT *, 1 - bear * bear AS sq FROM (
           SELECT *, CASE WHEN sn = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lon) / sn END AS bear, atan2(sn, cs) AS arc FROM (
             SELECT step, y1, x1, y2, x2, a, b, f, u1, u2, gap, lon,
               sqrt(pow(cos(u2) * sin(lon), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lon), 2)) AS sn,
               sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lon) AS cs
             FROM walk WHERE step < 20)))))),
   far AS (
     SELECT y1, x1, y2, x2, CASE WHEN moved <= 1e-12 AND abs(lon) <= pi() THEN b * big * (arc - small * sn * (mid + small / 4 * (
         cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * sn * sn - 3) * (4 * mid * mid - 3)))) ELSE 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(y2 - y1) / 2), 2)
         + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))) END AS km
     FROM (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small
       FROM (SELECT *, sq * (a * a - b * b) / (b * b) AS u FROM walk WHERE step = 20)))
   SELECT c_custkey, round(km, 6) AS "home-work" FROM resolved LEFT JOIN far ON y1 = home_lat AND x1 = home_lon AND y2 = work_lat AND x2 = work_lon"""


@query("G6_ellipsoid_distances", ELLIPSOID_SQL)
def apart_on_ellipsoid(spark, sf):
    # a small file is one task, and the iteration costs far more than the reading
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    resolved = distances(coordinates(spark, sf).repartition(tasks, "c_custkey"), ["home", "work"], ellipsoid_km)
    return rounded(resolved.select("c_custkey", "home-work"))


@query(
    "X1_enrich_stream",
    RESOLVED_SQL + " SELECT c_custkey, home, CAST(home_lat AS DOUBLE) AS home_lat, CAST(home_lon AS DOUBLE) AS home_lon FROM resolved",
)
def enriched_stream(spark, sf):
    source, target, checkpoint = (scratch_path(spark, s) for s in ("arrivals", "enriched", "enrich-state"))
    rows = addressed(spark, sf).select("c_custkey", "home")
    for part in (0, 1):
        # the second run starts where the first one stopped
        rows.where(F.col("c_custkey") % 2 == part).write.mode("append").parquet(source)
        enrich_stream(spark, source, rows.schema, "home", gazetteer(spark, sf), target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


@query(
    "X2_daily_stream",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
       SELECT day, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def counted_stream(spark, sf):
    source, target, checkpoint = (scratch_path(spark, s) for s in ("events-in", "daily-out", "daily-state"))
    events = table(spark, sf, "events").select("ts")
    events.write.parquet(source)
    daily_stream(spark, source, events.schema, "ts", target, checkpoint).awaitTermination()
    return spark.read.parquet(target)
