"""Approximate address resolution: the gazetteer's closest address within a few edits.

A string ``t`` cut into ``k + 1`` pieces of nearly equal length keeps one of them whole in any ``s`` within ``k`` edits.  Of
these take the first piece ``i`` up to whose end there are fewer than ``i`` edits: it is whole, with ``i - 1`` edits
before and at most ``k + 1 - i`` after it, so ``s`` holds it at one of a few places (19 in all for two edits).  Pieces grow with the
string, so the longer it is the fewer others meet it.  Strings with pieces of under ``2 * q`` characters would
meet too many; they meet in what is left of them after up to ``k`` deletions.  Both are posted as 64-bit keys, and
candidates are verified by the edit distance, which stops at ``k``.  A table of strings says nothing about the number of its
keys, so keys are never broadcast: they meet in a sort-merge join, whatever the estimates are.

Distinct strings are matched, so an address that fills a third of the table is matched once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .enrich import one_place


def numbers(first: Column | int, last: Column | int) -> Column:
    """The whole numbers from ``first`` to ``last``, none if it is smaller."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def piece(size: Column, pieces: int, i: int) -> tuple[Column, Column]:
    """Start and length of piece ``i`` (both from 1) of a string of ``size`` characters; the last ones take what is over."""
    least, over = F.floor(size / pieces).cast("int"), size % pieces
    return least * (i - 1) + F.greatest(F.lit(0), over - (pieces - i + 1)) + 1, least + (F.lit(pieces - i) < over).cast("int")


def piece_key(size: Column, i: int, text: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(size, F.lit(i), F.substring(text, start, length))


def own_pieces(text: Column, k: int) -> Column:
    """Keys of the string's pieces."""
    size = F.length(text)
    return F.array(*[piece_key(size, i, text, *piece(size, k + 1, i)) for i in range(1, k + 2)])


def pieces_within(text: Column, k: int, least: int) -> Column:
    """Keys of the pieces that strings of ``least`` characters or more may share with this one."""
    size = F.length(text)

    def at(i: int, other: Column) -> Column:
        start, length = piece(other, k + 1, i)
        ahead, after = size - other, k + 1 - i
        places = numbers(
            F.greatest(start - (i - 1), start + ahead - after, F.lit(1)), F.least(start + (i - 1), start + ahead + after, size - length + 1))
        return F.transform(places, lambda p: piece_key(other, i, text, p, length))

    sizes = numbers(F.greatest(size - k, F.lit(least)), size + k)
    return F.flatten(F.transform(sizes, lambda other: F.flatten(F.array(*[at(i, other) for i in range(1, k + 2)]))))


def shortened(text: Column, k: int) -> Column:
    """The string and all that is left of it after up to ``k`` deletions."""
    def without_one(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    levels = [F.array(text)]
    for _ in range(k):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], without_one))))
    return F.array_distinct(F.concat(*levels))


def closest(strings: DataFrame, others: DataFrame, k: int = 2, q: int = 3) -> DataFrame:
    """``(s, match, edits)``: of the strings ``t`` of ``others`` within ``k`` edits of ``s`` the closest, the smallest of several."""
    left = materialise(strings.select("s").where("s IS NOT NULL").distinct(), "strings")
    right = materialise(others.select("t").where("t IS NOT NULL").distinct(), "others")
    spark = strings.sparkSession
    # a small file is one task, and a string has up to a few hundred keys
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(tasks, "s"), right.repartition(tasks, "t")
    least = 2 * q * (k + 1)
    none = F.array().cast("array<bigint>")

    def remains(text: Column) -> Column:
        return F.transform(shortened(text, k), lambda rest: F.xxhash64(rest))

    posted = right.select("t", F.explode(F.when(F.length("t") >= least, own_pieces(F.col("t"), k)).otherwise(remains(F.col("t")))).alias("key"))
    asked = left.select("s", F.explode(F.array_distinct(F.concat(
        F.when(F.length("s") >= least - k, pieces_within(F.col("s"), k, least)).otherwise(none),
        F.when(F.length("s") < least + k, remains(F.col("s"))).otherwise(none)))).alias("key"))
    pairs = asked.join(posted.hint("merge"), "key").where(F.abs(F.length("s") - F.length("t")) <= k).select("s", "t")
    near = pairs.withColumn("edits", F.levenshtein("s", "t", k)).where("edits >= 0")
    best = near.groupBy("s").agg(F.min(F.struct("edits", "t")).alias("b"))
    return best.select("s", F.col("b.t").alias("match"), F.col("b.edits").alias("edits"))


def resolve_closest(df: DataFrame, fields: Sequence[str], gazetteer: DataFrame, k: int = 2, q: int = 3) -> DataFrame:
    """Add ``<field>_match``, ``<field>_edits``, ``<field>_lat`` and ``<field>_lon`` per address field.

    The closest address within ``k`` edits counts, of equally close ones the
    smallest; an unknown address gives nulls.  An exact address is 0 edits away.
    """
    places = materialise(one_place(gazetteer), "places")
    texts = df.select(F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("s"))
    found = closest(texts, places.select(F.col("address").alias("t")), k, q)
    known = materialise(found.join(places.hint("merge"), F.col("match") == F.col("address")).select("s", "match", "edits", "lat", "lon"), "resolved")
    for f in fields:
        named = known.select(F.col("s").alias("_s"), *[F.col(c).alias(f"{f}_{c}") for c in ("match", "edits", "lat", "lon")])
        df = df.join(named, F.col(f).cast("string") == F.col("_s"), "left").drop("_s")
    return df
