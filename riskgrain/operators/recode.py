"""Recoding through a mapping, feature choice by metadata, and set operations on samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import literal

# Mappings up to this many members are sent as one literal per task; larger ones
# are joined and left to the optimiser's own size check.
LITERAL_MAPPING = 2_000


def invert(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Group -> members turned into member -> group; a member may occur once."""
    member_of: dict[str, str] = {}
    for name, members in groups.items():
        for m in members:
            if m in member_of:
                raise ValueError(f"{m!r} is in two groups")
            member_of[m] = name
    return member_of


def mapping_frame(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return literal(df.sparkSession, list(mapping.items()), "member string, grp string")


def check_mapping(df: DataFrame, col: str, mapping: Mapping[str, str]) -> None:
    """Raise unless the mapping covers exactly the observed values."""
    observed = df.select(F.col(col).cast("string").alias("member")).where("member is not null").distinct()
    frame = mapping_frame(df, mapping)
    unknown = [r[0] for r in observed.join(frame, "member", "left_anti").limit(20).collect()]
    unused = [r[0] for r in frame.join(observed, "member", "left_anti").select("member").limit(20).collect()]
    if unknown or unused:
        raise ValueError(f"grouping must match the categories; not grouped: {unknown}, not present: {unused}")


def recode(
    df: DataFrame, col: str, mapping: Mapping[str, str], out: str = "bin", validate: bool = True
) -> DataFrame:
    """Replace the values of ``col`` through ``mapping``; null stays null."""
    if validate:
        check_mapping(df, col, mapping)
    if len(mapping) <= LITERAL_MAPPING:
        pairs = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
        return df.withColumn(out, F.try_element_at(pairs, F.col(col).cast("string")))
    frame = mapping_frame(df, mapping).withColumnRenamed("grp", out)
    return df.join(frame, F.col(col).cast("string") == F.col("member"), "left").drop("member")


def pick_features(
    df: DataFrame,
    feature_info: DataFrame,
    feature_type: str = "numerical",
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> list[str]:
    """Columns of ``df`` that the metadata gives this type, in column order.

    ``feature_info`` has columns ``feature`` and ``feature_type``.  Only names of
    actual columns reach the driver.
    """
    names = [c for c in df.columns if (include is None or c in set(include)) and c not in set(exclude or ())]
    typed = feature_info.where((F.col("feature_type") == feature_type) & F.col("feature").isin(names))
    kept = {r["feature"] for r in typed.select("feature").distinct().collect()}
    return [c for c in names if c in kept]


def union_samples(*samples: DataFrame) -> DataFrame:
    """Union by column name; the samples' keys are disjoint."""
    result = samples[0]
    for s in samples[1:]:
        result = result.unionByName(s)
    return result


def remaining(pool: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of ``pool`` whose key is not in ``taken``."""
    return pool.join(taken.select(key), key, "left_anti")


def members(pool: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``pool`` whose key is in ``wanted``."""
    return pool.join(wanted.select(key), key, "left_semi")
