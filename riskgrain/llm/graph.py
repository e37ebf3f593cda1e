"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    """Size and order-free digest of the edges; equal ones mean that nothing moved."""
    return tuple(edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))
    ).first())


#: Nodes with more than this share of all edges are few: fewer than twice its inverse.
HEAVY, LEAST_HEAVY = 0.001, 500


def _with_lowest(edges: DataFrame, lowest: DataFrame, total: int) -> DataFrame:
    """``edges`` with ``low`` of their ``u``; ``lowest`` has ``(u, low, n)``, ``n`` edges each.

    A node with very many edges would gather them in one task; such nodes are few by their share, so their rows
    travel to the edges instead.
    """
    heavy = F.col("n") > max(LEAST_HEAVY, HEAVY * total)
    few = F.broadcast(lowest.where(heavy).select("u", F.col("low").alias("known")))
    met = edges.join(few, "u", "left")
    light = met.where("known IS NULL").drop("known").join(lowest.where(~heavy).select("u", "low"), "u")
    return light.unionByName(met.where("known IS NOT NULL").withColumnRenamed("known", "low"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the smallest node of its component.

    Each round hangs neighbours on their smallest neighbour, once for the larger
    ones and once for the smaller ones, so a chain of any length is contracted
    in a logarithmic number of rounds.  Only a row count and a digest reach the
    driver; each round's edges are written to the shared folder.
    """
    current = materialise(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(),
        "edges")
    before = _fingerprint(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.count("*").alias("n"))
        larger = materialise(
            _with_lowest(both, lowest, 2 * before[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where("u <> v").distinct(), "edges")
        lowest = larger.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        smaller = (
            _with_lowest(larger, lowest, 2 * before[0]).select(
                F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))
                .alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        )
        current = materialise(smaller, "edges")
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
