"""Approximate addresses against all pairs, ellipsoidal distances against known lengths."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from riskgrain.functions import ellipsoid_km, haversine_km
from riskgrain.operators.closest import closest, resolve_closest, shortened


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mistyped(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + "é" + text[at:], text[:at] + text[at + 1:], text[:at] + rng.choice("abc ") + text[at + 1:]])
    return text


def places_and_typos():
    rng = random.Random(11)
    streets = ["Main Street", "Hauptstraße", "Rue de la Paix", "Calle", "A", "aaaaaaaaaaaa", "Via"]
    places = sorted({f"{rng.choice(streets)} {rng.randrange(1, 400)}" for _ in range(150)} | {"", "x", "ab", "aaaaaaaa", "aaaaaaaaa"})
    return rng, places


@pytest.mark.parametrize("k, q", [(2, 3), (1, 2), (2, 2)])
def test_no_pair_is_lost(spark, k, q):
    rng, places = places_and_typos()
    typos = sorted({mistyped(rng, rng.choice(places), rng.randrange(0, 4)) for _ in range(250)} | {"", "y", "qqqqqqqqqqqqq"})
    found = {r["s"]: (r["edits"], r["match"]) for r in closest(
        spark.createDataFrame([(t,) for t in [*typos, None]], "s string"), spark.createDataFrame([(p,) for p in [*places, None]], "t string"), k, q).collect()}
    want = {}
    for t in typos:
        best = min((plain_edits(t, p), p) for p in places)
        if best[0] <= k:
            want[t] = best
    assert found == want and any(e == k for e, _ in want.values()) and len(want) < len(typos)


def test_hot_address_and_odd_rows(spark):
    """An address in most rows, nulls, several rows for one place, and an empty gazetteer."""
    rows = [(k, "Main Stret 1" if k % 5 else None, "nowhere at all") for k in range(2000)] + [(None, "", "Main Street 1")]
    table = spark.createDataFrame(rows, "id long, home string, work string")
    places = spark.createDataFrame(
        [("Main Street 1", 2.0, 3.0), ("Main Street 1", 1.0, 9.0), ("Main Street 2", 0.0, 0.0), ("Far away", None, 1.0), (None, 1.0, 1.0)],
        "address string, lat double, lon double")
    found = resolve_closest(table, ["home", "work"], places)
    assert found.count() == len(rows)
    counts = {tuple(r)[:-1]: r["count"] for r in found.groupBy("home", "home_match", "home_edits", "home_lat", "home_lon", "work_match").count().collect()}
    assert counts == {
        ("Main Stret 1", "Main Street 1", 1, 1.0, 9.0, None): 1600, (None, None, None, None, None, None): 400,
        ("", None, None, None, None, "Main Street 1"): 1}
    assert resolve_closest(table, ["home"], places.limit(0)).where("home_match IS NOT NULL").count() == 0


def test_lengths_and_repeats(spark):
    """Any edits at any place of strings of all lengths around the change from remains to pieces, of two letters only."""
    rng = random.Random(5)
    places = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in range(0, 34) for _ in range(4)})
    typos = {t for p in places for t in (p, "", p + "ba", "ab" + p, p[2:], p[:-2], p[1:-1], "b" + p + "a", p[:9] + "ab" + p[9:], p[:5] + p[6:17] + "b" + p[17:])}
    typos = sorted(typos | {mistyped(rng, p, e) for p in places for e in (1, 2, 3)})
    found = {r["s"]: (r["edits"], r["match"]) for r in closest(
        spark.createDataFrame([(t,) for t in typos], "s string"), spark.createDataFrame([(p,) for p in places], "t string")).collect()}
    want = {t: min((plain_edits(t, p), p) for p in places if abs(len(p) - len(t)) <= 2) for t in typos if any(abs(len(p) - len(t)) <= 2 for p in places)}
    assert found == {t: b for t, b in want.items() if b[0] <= 2}


def test_many_addresses_of_few_grams_in_time(spark):
    """Addresses that all consist of the same few grams meet only where longer pieces agree."""
    syllables = F.array(*[F.lit(x) for x in ("the", "er", "and", "in", "th", "a ", "on", "re")])

    def spoken(seed):
        return F.concat(*[F.element_at(syllables, (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(8)) + 1).cast("int")) for k in range(12)])

    places = spark.range(30_000).repartition(8).select(spoken(0).alias("t"))
    typed = spark.range(60_000).repartition(8).select(
        F.when(F.col("id") % 2 == 0, F.overlay(spoken(0), F.lit("#"), F.lit(5), F.lit(2))).otherwise(spoken(100)).alias("s"))
    start = time.time()
    found = closest(typed, places)
    assert found.where(F.col("s").contains("#")).count() >= 14_900 and time.time() - start < 45


def test_keys_are_not_broadcast(spark):
    """A small table of short strings has some hundred times as many keys; they stay off the driver."""
    places = spark.range(2_000).select(F.format_string("%016x", F.xxhash64("id")).alias("t"))
    typed = places.select(F.concat(F.lit("-"), F.substring("t", 2, 20)).alias("s"))
    found = closest(typed, places)
    assert found.where("edits = 1").count() == 2_000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shortened(spark):
    found = spark.range(1).select(shortened(F.lit("abca"), 2).alias("r")).first()["r"]
    assert sorted(found) == sorted({"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"})


def length_on(spark, measure, *points):
    table = spark.createDataFrame(list(points), "a double, b double, c double, d double")
    return [r[0] for r in table.select(measure("a", "b", "c", "d")).collect()]


def on_ellipsoid(lat1, lon1, lat2, lon2):
    return ellipsoid_km(*[F.col(c) for c in (lat1, lon1, lat2, lon2)])


def meridian(lat, steps=20_000):
    """Length of the meridian from the equator, by Simpson's rule."""
    a, b = 6378.137, 6356.752314245
    e2 = 1 - b * b / a / a
    h = math.radians(lat) / steps
    f = [a * (1 - e2) / (1 - e2 * math.sin(k * h) ** 2) ** 1.5 for k in range(steps + 1)]
    return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


def test_ellipsoid_lengths(spark):
    found = length_on(
        spark, on_ellipsoid, (0.0, 0.0, 0.0, 1.0), (0.0, 5.0, 90.0, 5.0), (10.0, 7.0, 55.5, 7.0), (-30.0, 7.0, 30.0, 7.0), (0.0, 179.5, 0.0, -179.5),
        (48.0, 2.0, 48.0, 2.0), (89.0, 0.0, 89.0, 180.0))
    degree = 6378.137 * math.pi / 180
    want = [degree, meridian(90), meridian(55.5) - meridian(10), 2 * meridian(30), degree, 0.0, 2 * (meridian(90) - meridian(89))]
    assert all(abs(f - w) < 1e-6 for f, w in zip(found, want)), (found, want)


def test_ellipsoid_is_symmetric_and_near_the_sphere(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(300)]
    there = length_on(spark, on_ellipsoid, *points)
    back = length_on(spark, on_ellipsoid, *[(c, d, a, b) for a, b, c, d in points])
    sphere = length_on(spark, lambda *n: haversine_km(*[F.col(c) for c in n]), *points)
    assert all(abs(x - y) < 1e-6 for x, y in zip(there, back))
    assert all(abs(x - s) <= 0.006 * s + 1e-9 for x, s in zip(there, sphere))


def test_ellipsoid_defined_cases(spark):
    """Nearly antipodal points get the great circle; a null coordinate gives null."""
    points = [(0.0, 0.0, 0.3, 179.8), (0.0, 0.0, 0.0, 180.0), (None, 0.0, 1.0, 1.0)]
    found = length_on(spark, on_ellipsoid, *points)
    sphere = length_on(spark, lambda *n: haversine_km(*[F.col(c) for c in n]), *points)
    assert found[:2] == sphere[:2] and found[2] is None


def test_ellipsoid_of_many_rows_in_time(spark):
    """Each value of a step is computed once; 40,000 rows, most of which differ, take seconds and not minutes."""
    rows = spark.range(40_000).select(
        (F.col("id") % 173 - 86.5).alias("a"), (F.col("id") * 0.007 - 140).alias("b"), (F.col("id") % 167 - 83.1).alias("c"),
        (F.col("id") * -0.005 + 97).alias("d")).repartition(8)
    start = time.time()
    far = rows.select(ellipsoid_km(*[F.col(x) for x in "abcd"]).alias("km"))
    low, high = far.agg(F.min("km"), F.max("km")).first()
    assert 0 < low < high < 20_040 and time.time() - start < 60
