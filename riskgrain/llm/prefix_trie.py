"""Conversation prefix trie, its subtree figures from an Euler tour ranked as a distributed list.

Conversations are rebuilt so that they share beginnings: conversation ``c`` starts with the
first ``h`` turns of conversation ``c - c % 100`` (``h`` is ``crc32`` of the decimal ``c``, modulo 6)
and goes on with its own turns after its first ``h``.  Every distinct sequence of the first ``d`` turns
is a node of depth ``d``; its members are the conversations that begin with it, and the smallest
member with the depth names it.  Sequences are compared by 128 bits: the exclusive or of
hashes of (position, SHA-256 of role and text), summed along the conversation in chunks.

Every node has an enter and an exit arc.  An enter arc is followed by that of the node's first child
(children by name) or by the node's exit arc, an exit arc by the next sibling's enter arc or by the
parent's exit arc.  The list is ranked by contraction: first runs of arcs along one name, which
need no search for their neighbours, then pairs by random coins until ``REST`` elements are left; those
are ranked in one task and the contracted ones placed again, round by round.  Running sums of (leaf, saved
code points) over the arcs in order of their positions give a subtree as the difference of two of them.

Turns, children and arcs are dealt by range or by position, never by a key of unbounded size: a
conversation, a first turn or an ending that holds a third of all rows is spread like the others.
Endings are digested from blocks of 4,096 ids, streamed in order.

Defined cases: null role or text is empty; turns are ordered by number, null first, then by the SHA-256 of
role and text; repeated rows are turns of their own; rows with a null conversation take no part;
an empty table gives no node.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise

GROUP, MOST_SHARED = 100, 6
#: Rows of a range, of a chunk of running values, of a run of arcs.
RANGE_ROWS, MOST_RANGES, CHUNK, RUN = 16_384, 20_000, 1_024, 1_024
#: Elements ranked in one task.
REST = 8_192
#: Parents with more than this share of all children are few: fewer than its inverse.
HEAVY = 0.001
NODE = ["depth", "l0", "l1"]


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written with ``_range``, which ascends with ``order``; rows that tie in all of it may lie in either of two."""
    ranges = min(MOST_RANGES, max(1, math.ceil(df.count() / RANGE_ROWS)))
    return materialise(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], at: str, values: list[str], add, last: int, zero=0) -> DataFrame:
    """Every value combined with those at smaller positions of its key; positions are distinct in 0 to ``last``."""
    order = W.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    chunked = df.withColumn("_chunk", F.expr(f"`{at}` div {CHUNK}"))
    inside = chunked.select("*", *[add(F.col(v)).over(order).alias(f"_in_{v}") for v in values])
    if last < CHUNK:
        return inside.drop("_chunk", *values).withColumnsRenamed({f"_in_{v}": v for v in values})
    totals = chunked.groupBy(*keys, "_chunk").agg(*[add(F.col(v)).alias(v) for v in values]).withColumnRenamed("_chunk", f"{at}_")
    upto = running(totals, keys, f"{at}_", values, add, last // CHUNK, zero)
    before = upto.select(*keys, (F.col(f"{at}_") + 1).alias("_chunk"), *[F.col(v).alias(f"_to_{v}") for v in values])
    return inside.join(before, [*keys, "_chunk"], "left").select(
        *[c for c in df.columns if c not in values],
        *[combine(add, F.col(f"_in_{v}"), F.coalesce(f"_to_{v}", F.lit(zero))).alias(v) for v in values])


def combine(add, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if add is F.bit_xor else a + b


def shared_turns(conversation: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conversation.cast("string").cast("binary")) % MOST_SHARED).cast("long")


def rebuilt(turns: DataFrame, id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(c, at, said, chars)`` of every turn of the rebuilt conversations, from 1, and ``(c, size)`` of every conversation."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    read = materialise(
        turns.where(F.col(id).isNotNull()).select(
            F.col(id).cast("long").alias("c"), F.col(turn).alias("turn"), said.alias("said"), F.length(t).cast("long").alias("chars"))
        .withColumn("row", F.monotonically_increasing_id()), "turns")
    # equal rows are told apart by ``row``, so that even they can be dealt to several ranges
    dealt = in_ranges(read, "c", "turn", "said", "row")
    earlier = W.partitionBy("c").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("c", "_range").agg(F.count("*").alias("n")).select(
        "c", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("c", "_range").orderBy("turn", "said", "row")
    own = materialise(
        dealt.withColumn("k", F.row_number().over(inside)).join(offsets, ["c", "_range"])
        .select("c", (F.col("k") + F.col("before")).alias("k"), "said", "chars"), "own")

    sizes = own.groupBy("c").agg(F.count("*").alias("n"))
    givers = sizes.where(F.col("c") % GROUP == 0).select(F.col("c").alias("g"), F.col("n").alias("given"))
    plan = (
        sizes.withColumn("g", F.col("c") - F.col("c") % GROUP).join(givers, "g", "left")
        .withColumn("h", shared_turns(F.col("c"))).withColumn("given", F.least("h", F.coalesce("given", F.lit(0)))))
    plan = materialise(plan.select("c", "g", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "plan")
    heads = own.where((F.col("c") % GROUP == 0) & (F.col("k") < MOST_SHARED)).withColumnRenamed("c", "g")
    taken = plan.where("given > 0").select("c", "g", F.explode(F.expr("sequence(1L, given)")).alias("k")).join(heads, ["g", "k"]).select(
        "c", F.col("k").alias("at"), "said", "chars")
    kept = own.join(plan.select("c", "h", "given"), "c").where("k > h").select(
        "c", (F.col("given") + F.col("k") - F.col("h")).alias("at"), "said", "chars")
    return taken.unionByName(kept), plan.select("c", "size")


def nodes_of(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """``depth, l0, l1, conv_id, parent_conv_id, n_convs, n_children, first_child, chars`` of every node."""
    own = paths.groupBy(F.col("at").alias("depth"), "l0", "l1").agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("p0").alias("p0"), F.min("p1").alias("p1"))
    root = conversations.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").selectExpr(
        "0L AS depth", "0L AS l0", "0L AS l1", "conv_id", "n_convs", "0L AS chars", "NULL AS p0", "NULL AS p1")
    found = materialise(own.unionByName(root.select(own.columns)), "nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("l0"), F.col("p1").alias("l1")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    found = materialise(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    heavy = F.col("n_children") > max(256, HEAVY * found.count())
    parents = found.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("l0").alias("p0"), F.col("l1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), heavy.alias("heavy"))
    few = F.broadcast(parents.where("heavy").withColumnRenamed("parent_conv_id", "known").drop("heavy"))
    kids = found.join(few, ["depth", "p0", "p1"], "left")
    light = kids.where("known IS NULL").drop("known").join(parents.where("NOT heavy").drop("heavy"), ["depth", "p0", "p1"], "left")
    rest = kids.where("known IS NOT NULL").withColumnRenamed("known", "parent_conv_id")
    return materialise(light.unionByName(rest.select(light.columns)).drop("p0", "p1"), "nodes")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes with ``sibling``, the name of the next child of their parent."""
    family = ["parent_conv_id", "depth"]
    dealt = in_ranges(nodes, *family, "conv_id")
    starts = dealt.groupBy(*family, "_range").agg(F.min("conv_id").alias("start"))
    onward = starts.select(*family, "_range", F.lead("start").over(W.partitionBy(*family).orderBy("_range")).alias("start"))
    inside = W.partitionBy(*family, "_range").orderBy("conv_id")
    # the root has no parent, and the equality of the join leaves it without a sibling
    return dealt.withColumn("_next", F.lead("conv_id").over(inside)).join(onward, [*family, "_range"], "left").withColumn(
        "sibling", F.coalesce("_next", "start")).drop("_next", "start", "_range")


def arcs_of(nodes: DataFrame) -> DataFrame:
    """``(c, s, nc, ns, head, skip, leaf, saved)``: arcs ``s = 2 * depth`` (enter) and ``2 * depth + 1`` (exit), the arc
    that follows, and the run they belong to: ``skip`` arcs after the arc ``(c, head)``."""
    enter = nodes.select(
        F.col("conv_id").alias("c"), (2 * F.col("depth")).alias("s"), F.coalesce("first_child", "conv_id").alias("nc"),
        F.when(F.col("n_children") > 0, 2 * F.col("depth") + 2).otherwise(2 * F.col("depth") + 1).alias("ns"),
        (F.coalesce(F.col("parent_conv_id") != F.col("conv_id"), F.lit(True)) | (F.col("depth") % RUN == 0)).alias("heads"),
        F.lit(0).alias("up"), F.col("depth").alias("along"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    leave = nodes.select(
        F.col("conv_id").alias("c"), (2 * F.col("depth") + 1).alias("s"), F.coalesce("sibling", "parent_conv_id").alias("nc"),
        F.when(F.col("parent_conv_id").isNotNull(), F.when(F.col("sibling").isNotNull(), 2 * F.col("depth")).otherwise(2 * F.col("depth") - 1)).alias("ns"),
        (~F.coalesce((F.col("first_child") == F.col("conv_id")) & (F.col("n_children") == 1), F.lit(False)) | ((F.col("depth") + 1) % RUN == 0)).alias("heads"),
        F.lit(1).alias("up"), (-F.col("depth")).alias("along"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    both = enter.unionByName(leave).withColumn("block", F.expr(f"s div {2 * RUN}"))
    upto = W.partitionBy("c", "up", "block").orderBy("along").rowsBetween(W.unboundedPreceding, 0)
    start = F.max(F.when(F.col("heads"), F.col("along"))).over(upto)
    return materialise(both.withColumn("_start", start).select(
        "c", "s", "nc", "ns", (2 * F.abs("_start") + F.col("up")).alias("head"), (F.col("along") - F.col("_start")).alias("skip"), "leaf", "saved"), "arcs")


def _chase(rows: pa.Table) -> pa.Table:
    """Positions of the elements of a short list: ``(c, s, nc, ns, w)``."""
    ids = list(zip(rows["c"].to_pylist(), rows["s"].to_pylist()))
    after = dict(zip(ids, zip(rows["nc"].to_pylist(), rows["ns"].to_pylist(), rows["w"].to_pylist())))
    at, position = next(iter(set(ids) - {(c, s) for c, s, _ in after.values()})), 0
    places = {}
    while at in after:
        places[at] = position
        c, s, w = after[at]
        at, position = (c, s), position + w
    return pa.table({
        "c": pa.array([i[0] for i in ids], pa.int64()), "s": pa.array([i[1] for i in ids], pa.int64()),
        "position": pa.array([places[i] for i in ids], pa.int64())})


def list_positions(elements: DataFrame, rest: int = REST) -> DataFrame:
    """``(c, s, position)`` of the elements ``(c, s, nc, ns, w)`` of one linked list: the sum of ``w`` before each.

    In each round an element whose coin shows heads and whose predecessor's shows tails is merged into
    it: about a quarter.  Coins are hashes of the name and the round, so a repeated task finds the same.
    """
    current, removed = materialise(elements, "list"), []
    left = current.count()
    while left > rest:
        coin = F.xxhash64("c", "s", F.lit(len(removed))).bitwiseAND(F.lit(1))
        stay = current.where(coin == 0)
        go = current.where(coin == 1).select(
            F.col("c").alias("xc"), F.col("s").alias("xs"), F.col("nc").alias("xnc"), F.col("ns").alias("xns"), F.col("w").alias("xw"))
        met = materialise(stay.join(go, (F.col("nc") == F.col("xc")) & (F.col("ns") == F.col("xs")), "full_outer"), "round")
        removed.append(met.where("c IS NOT NULL AND xc IS NOT NULL").select("c", "s", F.col("xc"), F.col("xs"), "w"))
        alone, merged = F.col("c").isNull(), F.col("xc").isNotNull()
        current = met.select(
            F.coalesce("c", "xc").alias("c"), F.coalesce("s", "xs").alias("s"), F.when(merged, F.col("xnc")).otherwise(F.col("nc")).alias("nc"),
            F.when(merged, F.col("xns")).otherwise(F.col("ns")).alias("ns"),
            F.when(alone, F.col("xw")).otherwise(F.col("w") + F.coalesce("xw", F.lit(0))).alias("w"))
        left = current.count()
    places = current.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_chase, "c long, s long, position long")
    for gone in reversed(removed):
        places = materialise(places, "places")
        again = gone.join(places, ["c", "s"]).select(F.col("xc").alias("c"), F.col("xs").alias("s"), (F.col("position") + F.col("w")).alias("position"))
        places = places.unionByName(again)
    return materialise(places, "places")


def _digest(batches):
    """SHA-256 of each node's joined id blocks; rows arrive by node, then by block."""
    node, digest = None, None

    def done():
        return pa.record_batch({
            **{n: pa.array([v], pa.int64()) for n, v in zip(NODE, node)}, "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
            if key != node:
                if node is not None:
                    yield done()
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node is not None:
        yield done()


def endings(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(depth, l0, l1, ends_sha256)`` of the nodes at which a conversation ends."""
    last = paths.select("c", F.col("at").alias("size"), "l0", "l1").join(conversations, ["c", "size"]).select(F.col("size").alias("depth"), "l0", "l1", "c")
    none = conversations.where("size = 0").selectExpr("0L AS depth", "0L AS l0", "0L AS l1", "c")
    blocks = last.unionByName(none).groupBy(*NODE, F.shiftright("c", 12).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(
        _digest, "depth long, l0 long, l1 long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rest: int = REST,
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    steps, conversations = rebuilt(turns, id, turn, role, text)
    longest = conversations.agg(F.max("size")).first()[0] or 0
    marked = steps.withColumn("x0", F.xxhash64(F.lit(0), "at", "said")).withColumn("x1", F.xxhash64(F.lit(1), "at", "said")).drop("said")
    summed = running(marked.withColumns({"l0": F.col("x0"), "l1": F.col("x1")}), ["c"], "at", ["l0", "l1"], F.bit_xor, longest)
    paths = materialise(summed.select(
        "c", "at", "chars", "l0", "l1", F.col("l0").bitwiseXOR(F.col("x0")).alias("p0"), F.col("l1").bitwiseXOR(F.col("x1")).alias("p1")), "paths")

    nodes = with_siblings(nodes_of(paths, conversations))
    nodes = materialise(nodes.join(endings(paths, conversations), NODE, "left").drop("l0", "l1"), "nodes")
    arcs = arcs_of(nodes)
    runs = arcs.groupBy("c", F.col("head").alias("s")).agg(
        F.max_by("nc", "skip").alias("nc"), F.max_by("ns", "skip").alias("ns"), F.count("*").alias("w"))
    heads = list_positions(runs, rest).select("c", F.col("s").alias("head"), "position")
    placed = arcs.join(heads, ["c", "head"]).select("c", "s", (F.col("position") + F.col("skip")).alias("at"), "leaf", "saved")
    summed = running(placed, [], "at", ["leaf", "saved"], F.sum, 2 * nodes.count())
    enter = F.col("s") % 2 == 0
    trees = summed.groupBy(F.col("c").alias("conv_id"), F.expr("s div 2").alias("depth")).agg(*[
        (F.sum(F.when(enter, 0 - F.col(v)).otherwise(F.col(v)))).alias(f"_{v}") for v in ("leaf", "saved")])
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    return nodes.join(trees, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("_leaf") + own_leaf).alias("n_leaves"),
        (F.col("_saved") + own_saved).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
