"""Resumable enrichment of rows with coordinates and labels.

The lookup service is a gazetteer table ``(address, lat, lon)``: resolving an
address is a join, and a run continues where the stored results end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import haversine_km
from ..plans.prefix import running_totals
from ..session import literal


def pending(df: DataFrame, done: DataFrame, key: str, retry_failed: Sequence[str] = ()) -> DataFrame:
    """Rows not yet in ``done``.

    A stored row counts as done even when its lookup failed, unless the names of
    coordinate columns are given in ``retry_failed``: rows where any of them is
    null are then queued again.
    """
    finished = done
    for c in retry_failed:
        finished = finished.where(F.col(c).isNotNull())
    return df.join(finished.select(key), key, "left_anti")


def next_batch(df: DataFrame, key: str, amount: int) -> DataFrame:
    """The first ``amount`` rows by key; null keys come last and are never taken.

    Running counts over the keys find the last one, so a batch of any size is a
    filter and never passes through one task.  Of rows that share the last key
    only as many are taken as fit.
    """
    totals = running_totals(df.select(key), key, {"c": F.count("*")}, [])
    last = totals.where(F.col("cum_c") >= amount).orderBy(key).limit(1).collect()
    if not last:
        return df.where(F.col(key).isNotNull())
    end, spare = last[0][key], last[0]["cum_c"] - amount
    if not spare:
        return df.where(F.col(key) <= F.lit(end))
    ties = df.where(F.col(key) == F.lit(end)).limit(last[0]["c"] - spare)
    return df.where(F.col(key) < F.lit(end)).unionByName(ties)


def one_place(gazetteer: DataFrame) -> DataFrame:
    """One row per address: of several the one with the smallest latitude, then longitude; both coordinates of one row."""
    place = F.min(F.struct("lat", "lon"))
    return gazetteer.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("address").agg(place.alias("at")).select(
        "address", "at.lat", "at.lon")


def resolve(df: DataFrame, key: str, fields: Sequence[str], gazetteer: DataFrame) -> DataFrame:
    """Add ``<field>_lat`` and ``<field>_lon`` per address field; unknown addresses give null.

    One join per field with one row per address; how it runs is left to the
    optimiser's size estimates, and the rows of a very frequent address are split
    by its handling of skewed joins.
    """
    places = one_place(gazetteer)
    for f in fields:
        named = places.select(F.col("address").alias("_address"), F.col("lat").alias(f"{f}_lat"), F.col("lon").alias(f"{f}_lon"))
        df = df.join(named, F.col(f) == F.col("_address"), "left").drop("_address")
    return df


def attach_label(df: DataFrame, labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Append the label looked up by key."""
    return df.join(labels.select(key, label), key, "left")


def distances(df: DataFrame, fields: Sequence[str], measure: Callable[..., Column] = haversine_km) -> DataFrame:
    """Kilometres between each pair of the row's coordinate fields, named ``a-b``: great circles, or ``ellipsoid_km``."""
    pairs = {
        f"{a}-{b}": measure(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon"))
        for a, b in combinations(fields, 2)
    }
    return df.withColumns(pairs)


def run_batch(
    df: DataFrame, key: str, fields: Sequence[str], gazetteer: DataFrame, result_path: str, amount: int,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Resolve the next ``amount`` rows, append them to the result table, report progress.

    Returns one row ``(extracted, remaining, total)``.
    """
    spark = df.sparkSession
    stored = stored_results(spark, result_path)
    todo = df if stored is None else pending(df, stored, key)
    batch = resolve(next_batch(todo, key, amount), key, fields, gazetteer)
    if labels is not None:
        batch = attach_label(batch, labels, key)
    before = 0 if stored is None else stored.count()
    batch.write.mode("append").parquet(result_path)
    after = stored_results(spark, result_path).count()
    total = df.count()
    row = (after - before, total - after, total)
    return literal(spark, [row], "extracted bigint, remaining bigint, total bigint")


def stored_results(spark, path: str) -> DataFrame | None:
    """The result table, or None before the first run."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(target) else None
