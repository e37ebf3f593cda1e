"""Scalar column expressions.  All are native Spark expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MISSING = "missing"
EARTH_RADIUS_KM = 6371.0088
#: Half axes of the WGS 84 ellipsoid.
EQUATOR_KM, POLE_KM = 6378.137, 6356.752314245
ELLIPSOID_STEPS = 20
POSITIVE_INFINITY = float("inf")


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Double with NaN turned into null, so that NaN never sorts as largest."""
    d = as_column(c).cast("double")
    return F.when(~F.isnan(d), d)


def flag(c: str | Column, value=1) -> Column:
    """0/1 response: 1 where ``c`` equals ``value``; null counts as 0."""
    return as_column(c).eqNullSafe(F.lit(value)).cast("int")


def or_missing(c: str | Column, name: str = MISSING) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(name))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator (ANSI mode would raise)."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def key_date(c: str | Column) -> Column:
    """Date held in a business key.

    18-character keys carry ``yyyyMMdd`` at characters 6-13, 13-character keys at
    characters 1-8.  Any other length, and any impossible date, gives null.
    """
    key = as_column(c).cast("string")
    digits = F.when(F.length(key) == 18, F.substring(key, 6, 8)).when(
        F.length(key) == 13, F.substring(key, 1, 8)
    )
    return F.when(digits.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def month_key(c: str | Column) -> Column:
    """Calendar month as the integer ``yyyymm``."""
    d = as_column(c)
    return F.year(d) * 100 + F.month(d)


def shift_months(c: str | Column, months: int) -> Column:
    """Move a date by whole months, clipped to the end of the target month."""
    return F.add_months(as_column(c).cast("date"), months)


def percent_text(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def interval_label(lo: Column, hi: Column) -> Column:
    """Display form ``(lo, hi]``; the numbers stay authoritative."""
    return F.when(hi.isNull(), F.lit(MISSING)).otherwise(
        F.concat(F.lit("("), lo.cast("string"), F.lit(", "), hi.cast("string"), F.lit("]"))
    )


def interval_ends(label: str | Column) -> tuple[Column, Column]:
    """Read ``(lo, hi]`` labels from imported tables; other text gives nulls."""
    text = as_column(label)
    pattern = r"^[\(\[]\s*([^,\s]+)\s*,\s*([^,\s]+)\s*[\)\]]$"

    def part(i: int) -> Column:
        piece = F.regexp_extract(text, pattern, i)
        piece = F.regexp_replace(piece, "(?i)^([+-]?)inf$", "$1Infinity")
        return F.when(piece != "", piece).try_cast("double")

    return part(1), part(2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))) * (2 * EARTH_RADIUS_KM)


def ellipsoid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length in kilometres of the shortest way on the WGS 84 ellipsoid.

    The inverse problem by Vincenty's series, ``ELLIPSOID_STEPS`` steps of its
    iteration for the difference of longitudes on the auxiliary sphere; half a
    millimetre exact.  Where the iteration has not settled by then, which takes
    nearly antipodal points, the great-circle distance is given instead; it is at
    most 0.6 % off.
    """
    flat = (EQUATOR_KM - POLE_KM) / EQUATOR_KM
    zero, one = F.lit(0.0), F.lit(1.0)
    tan1, tan2 = (F.tan(F.radians(lat)) * (1 - flat) for lat in (lat1, lat2))
    gap = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    start = F.struct(
        gap.alias("gap"), gap.alias("lon"), (1 / F.sqrt(1 + tan1 * tan1)).alias("c1"), (tan1 / F.sqrt(1 + tan1 * tan1)).alias("s1"),
        (1 / F.sqrt(1 + tan2 * tan2)).alias("c2"), (tan2 / F.sqrt(1 + tan2 * tan2)).alias("s2"),
        one.alias("moved"), *[zero.alias(n) for n in ("sin", "cos", "arc", "square", "middle")])

    def bound(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def step(x: Column, _: Column) -> Column:
        across = x["c2"] * F.sin(x["lon"])
        along = x["c1"] * x["s2"] - x["s1"] * x["c2"] * F.cos(x["lon"])

        # every value is named once: a column used twice is computed twice
        def turned(t: Column) -> Column:
            bearing = F.when(t["sin"] == 0, zero).otherwise(x["c1"] * x["c2"] * F.sin(x["lon"]) / t["sin"])
            return bound(bearing, lambda bearing: bound(1 - bearing * bearing, lambda square: settled(t, bearing, square)))

        def settled(t: Column, bearing: Column, square: Column) -> Column:
            middle = F.when(square <= 1e-15, zero).otherwise(t["cos"] - 2 * x["s1"] * x["s2"] / square)
            c = flat / 16 * square * (4 + flat * (4 - 3 * square))
            return bound(F.struct(middle.alias("middle"), c.alias("c")), lambda v: bound(moved(t, bearing, v["middle"], v["c"]), lambda lon: F.struct(
                x["gap"].alias("gap"), lon.alias("lon"), *[x[n].alias(n) for n in ("c1", "s1", "c2", "s2")],
                F.abs(lon - x["lon"]).alias("moved"), t["sin"].alias("sin"), t["cos"].alias("cos"), t["arc"].alias("arc"),
                square.alias("square"), v["middle"].alias("middle"))))

        def moved(t: Column, bearing: Column, middle: Column, c: Column) -> Column:
            return x["gap"] + (1 - c) * flat * bearing * (
                t["arc"] + c * t["sin"] * (middle + c * t["cos"] * (2 * middle * middle - 1)))

        return bound(F.struct(across.alias("across"), along.alias("along"), (x["s1"] * x["s2"] + x["c1"] * x["c2"] * F.cos(x["lon"])).alias("cos")), lambda v: bound(
            F.sqrt(v["across"] * v["across"] + v["along"] * v["along"]), lambda sine: bound(
                F.struct(sine.alias("sin"), v["cos"].alias("cos"), F.atan2(sine, v["cos"]).alias("arc")), turned)))

    def length(x: Column) -> Column:
        u = x["square"] * (EQUATOR_KM ** 2 - POLE_KM ** 2) / POLE_KM ** 2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m2 = x["middle"] * x["middle"]
        correction = b * x["sin"] * (x["middle"] + b / 4 * (
            x["cos"] * (2 * m2 - 1) - b / 6 * x["middle"] * (4 * x["sin"] * x["sin"] - 3) * (4 * m2 - 3)))
        settled = (x["moved"] <= 1e-12) & (F.abs(x["lon"]) <= math.pi)
        return F.when(settled, POLE_KM * a * (x["arc"] - correction)).otherwise(haversine_km(lat1, lon1, lat2, lon2))

    # a longitude that did not move at all gives the same step again
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(ELLIPSOID_STEPS)), start, lambda x, i: F.when(x["moved"] == 0, x).otherwise(step(x, i)), length)
    return F.when(lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull(), walked)


def hash_text(key: str | Column | Sequence[str], seed: int) -> Column:
    """Reproducible pseudo-random text per row: ``md5(key:seed)``."""
    parts = [key] if isinstance(key, (str, Column)) else list(key)
    cols = [as_column(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols, F.lit(str(seed))))


def hash_halves(text: Column) -> tuple[Column, Column]:
    """Hex digits 1-13 and 14-26 as 52-bit integers; their order is the text's order."""
    return (
        F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint"),
        F.conv(F.substring(text, 14, 13), 16, 10).cast("bigint"),
    )


def hash_unit(text: Column) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits."""
    return hash_halves(text)[0].cast("double") / F.lit(float(1 << 52))
