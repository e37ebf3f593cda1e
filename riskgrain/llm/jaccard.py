"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

The documents' sets of word five-grams are compared.  Equal sets are one class
from the start, so copies are never compared with each other.  Class
representatives that share a band of four MinHash values are candidates; with 32
bands a pair at the threshold of 0.8 shares none with a probability below 1e-7.
Candidate pairs are compared bucket by bucket, a byte of each MinHash value and sixteen
values at a time; a pair is dropped as soon as the posterior probability (uniform prior) that its
similarity reaches the threshold falls below the tolerance (bytes only add matches, so none is dropped that whole
values would keep).  Buckets return a spanning label for each row; the components of what
survives hold all links, and little else: texts that merely share a passage do not survive.

Links are then counted inside each component, in tiles of bounded size: whole MinHash values
are compared by the same steps, and the pairs left are verified on the whole sets.  A tile
returns link counts and a spanning label for each row, never its pairs.

Defined cases: a text of fewer than five words has one gram, all its words; a text
without words, a null text and a row with a null id have no links and are their
own class (the null id keeps a null class).  Repeated rows are copies of each other;
rows that share an id but not a text are compared separately.  Words of ASCII letters and digits (lower-cased) and non-ASCII characters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .graph import components
from .words import hash_ngrams, hash_words, mix, text_chunks

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TILE_ROWS = 1024
TILE_GRAMS = 1_000_000
BUNDLE_GRAMS = 100_000
#: Rows of a block of a bucket, and pairs compared at once.
BUCKET_ROWS, PAIRS_AT_ONCE = 1024, 30_000
#: Copies of a set that meet its row in one task.
COPIES = 500
#: A character of a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

_NUMBERS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS = (_NUMBERS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_NUMBERS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for start, stop, data, offsets in text_chunks(texts):
        words, first = hash_words(data, offsets)
        grams = hash_ngrams(words, n)
        for row in range(stop - start):
            a, b = first[row], first[row + 1]
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield hash_ngrams(words[a:b], int(b - a))
            else:
                yield np.empty(0, np.uint64)


def minhash(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    values = (grams >> np.uint64(32)).astype(np.uint32)
    lowest = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 2048):
        hashed = _FACTORS[:, None] * values[None, k:k + 2048]
        hashed += _SHIFTS[:, None]
        np.minimum(lowest, hashed.min(axis=1), out=lowest)
    return lowest


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def sketch_bytes(signature: np.ndarray) -> np.ndarray:
    """A byte of each value."""
    return (mix(signature.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def needed_matches(threshold: float, tolerance: float) -> list[int]:
    """Fewest equal values after each step for which the posterior of ``similarity >= threshold`` reaches the tolerance.

    With a uniform prior, ``m`` of ``n`` equal values give a Beta(m+1, n-m+1)
    posterior, whose upper tail is that of a binomial of ``n + 1`` trials.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m < n:
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        needed.append(m)
    return needed


def _sketch(n: int):
    def run(batches):
        for batch in batches:
            sets = list(gram_sets(batch.column(1), n))
            filled = [k for k, s in enumerate(sets) if len(s)]
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = np.frombuffer(
                b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            counts = np.zeros(len(sets), np.int32)
            counts[filled] = BANDS
            signatures = [minhash(sets[k]) for k in filled]
            keys = band_keys(np.stack(signatures)) if filled else np.empty(0, np.int64)
            short = dict(zip(filled, (sketch_bytes(v).tobytes() for v in signatures)))
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.record_batch({
                "id": batch.column(0), "size": pa.array(sizes), "set_a": pa.array(digests[:, 0]),
                "set_b": pa.array(digests[:, 1]), "bands": bands,
                "sketch": pa.array([short.get(k) for k in range(len(sets))], pa.binary())})
    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            sets = list(gram_sets(batch.column("text"), n))
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("rep", "root", "weight", "blocks")},
                "grams": pa.array([s.tobytes() for s in sets], pa.binary()),
                "signature": pa.array([minhash(s).tobytes() if len(s) else b"" for s in sets], pa.binary())})
    return run


def spanning(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that pairs lead to from each row."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (before == label).all():
            return label


def pairs_of_blocks(starts: np.ndarray, sizes: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same block, some at a time: all of side 0, and those of side 1 with those of side 2, which come last."""
    ends = np.repeat(starts + sizes, sizes)
    row = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes)]) if len(starts) else np.empty(0, np.int64)
    others = np.repeat(np.add.reduceat(sides == 2, starts) if len(starts) else 0, sizes)
    first = np.where(sides[row] == 0, row + 1, ends - others)
    counts = np.where(sides[row] == 2, 0, ends - first)
    reach = np.cumsum(counts)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = counts[at:stop]
        i = np.repeat(row[at:stop], n)
        within = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, np.repeat(first[at:stop], n) + within
        at = stop


def _survivors(needed: list[int]):
    """Spanning labels of the candidate pairs that no step drops; rows arrive by bucket, tile and side."""
    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
            marks = mark(table)
            last = int(np.searchsorted(marks, marks[-1]))
            # whole tiles only; their size is bounded
            if last and len(table) >= 20_000:
                yield judged(table.slice(0, last), marks[:last])
                table = table.slice(last)
            carry = table
        if carry is not None and len(carry):
            yield judged(carry, mark(carry))

    def mark(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table), np.int64)
        for name in ("key", "low", "high"):
            column = table[name].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        return np.cumsum(change)

    def judged(table: pa.Table, marks: np.ndarray) -> pa.RecordBatch:
        reps, sides = table["rep"].to_numpy(), table["side"].to_numpy()
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, HASHES)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(marks)]]))
        label = np.arange(len(reps))
        for i, j in pairs_of_blocks(starts, sizes, sides):
            # what already hangs together needs no further comparison
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            matches = np.zeros(len(i), np.int32)
            for step, least in enumerate(needed):
                if not len(i):
                    break
                part = slice(step * STEP, (step + 1) * STEP)
                matches = matches + (sketches[i, part] == sketches[j, part]).sum(axis=1, dtype=np.int32)
                keep = matches >= least
                i, j, matches = i[keep], j[keep], matches[keep]
            if len(i):
                label = spanning(len(reps), label[i], label[j])[label]
        rows = np.flatnonzero(label != np.arange(len(reps)))
        labels = label[rows]
        a, b = np.unique(np.stack([reps[rows], reps[labels]], axis=1), axis=0).T if len(rows) else (rows, rows)
        return pa.record_batch({"rep": pa.array(a, pa.int64()), "label": pa.array(b, pa.int64())})

    return run


def _surviving(left: np.ndarray, right: np.ndarray, same: bool, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that no step of the comparison drops; ``same``: of one block, each pair once."""
    equal = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STEP):
        equal += left[:, k, None] == right[None, :, k]
    alive = equal >= needed[0]
    i, j = np.nonzero(np.triu(alive, 1) if same else alive)
    matches = equal[i, j].astype(np.int32)
    for step in range(1, HASHES // STEP):
        if not len(i):
            break
        k = slice(step * STEP, (step + 1) * STEP)
        for a in range(0, len(i), 1 << 17):
            part = slice(a, a + (1 << 17))
            matches[part] += (left[i[part], k] == right[j[part], k]).sum(axis=1, dtype=np.int32)
        keep = matches >= needed[step]
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact size of each pair's intersection, pair by pair or, where that is cheaper, by products of incidence blocks."""
    rows_i, at_i = np.unique(i, return_inverse=True)
    rows_j, at_j = np.unique(j, return_inverse=True)
    used = np.union1d(rows_i, rows_j)
    grams, code, counts = np.unique(np.concatenate([sets[r] for r in used]), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    wide = int(shared[-1]) + 1
    if len(i) * 2e-5 < len(rows_i) * len(rows_j) * wide * 1e-10:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    owner = np.repeat(np.arange(len(used)), [len(sets[r]) for r in used])
    keep = counts[code] > 1
    owner, column = owner[keep], shared[code[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(rows_i), len(rows_j)), np.float32)
    where_i, where_j = np.searchsorted(used, rows_i), np.searchsorted(used, rows_j)
    for start in range(0, wide, 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        block = np.zeros((len(used), 2048), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        total += block[where_i] @ block[where_j].T
    return total[at_i, at_j].astype(np.int64)


def _verify(threshold: float, needed: list[int]):
    def tile(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        reps, weights = rows["rep"].to_numpy(), rows["weight"].to_numpy()
        signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(b, np.uint64) for b in rows["grams"].to_pylist()]
        blocks = rows["block"].to_numpy()
        left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
        same = blocks.min() == blocks.max()
        if not same or rows["inner"][0].as_py():
            i, j = _surviving(signatures[left], signatures[right], same, needed)
            i, j = left[i], right[j]
        else:
            i = j = np.empty(0, np.int64)
        if not len(i):
            return []
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _common(sets, i, j)
        linked = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
        linked &= reps[i] != reps[j]
        i, j = i[linked], j[linked]
        links = np.bincount(i, weights[j], len(reps)) + np.bincount(j, weights[i], len(reps))
        label = reps.copy()
        while True:
            before = label.copy()
            np.minimum.at(label, i, before[j])
            np.minimum.at(label, j, before[i])
            if (before == label).all():
                break
        at = np.flatnonzero(links)
        return [(reps[at], links[at].astype(np.int64), label[at])]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("root")
        if len(rows) > len(rows["rep"].unique()):  # repeated rows of the input
            first = {key: k for k, key in reversed(list(enumerate(zip(rows["rep"].to_pylist(), rows["grams"].to_pylist()))))}
            rows = rows.take(sorted(first.values()))
        roots = rows["root"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(roots)) + 1, [len(roots)]])
        found = [x for a, b in zip(cuts[:-1], cuts[1:]) for x in tile(rows.slice(a, b - a))]
        reps, links, labels = (
            np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
        return pa.table({"rep": reps, "links": links, "label": labels})
    return run


def similarity_classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7,
) -> DataFrame:
    """``(id, class_id, n_links)``: one row per document, its class (smallest id) and the documents it is linked with.

    Two documents are linked if the Jaccard similarity of their n-gram sets
    reaches ``threshold``; classes are the connected components of the links.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = materialise(
        source.where("id IS NOT NULL").mapInArrow(
            _sketch(n), "id long, size long, set_a long, set_b long, bands array<long>, sketch binary"), "sketch")
    # written first, so that the join shuffles both sides anew and the rows of a set with very many copies can be split
    sets = materialise(sketch.where("size > 0").groupBy("set_a", "set_b").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in ("size", "bands", "sketch")]), "sets")
    classed = materialise(
        sketch.where("size > 0").select("id", "set_a", "set_b").join(sets.select("set_a", "set_b", "rep", "weight"), ["set_a", "set_b"])
        .select("id", "rep", "weight"), "classed")

    needed = needed_matches(threshold, tolerance)
    banded = sets.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = materialise(banded.join(buckets, "key").select(
        "rep", "key", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("blocks")), "shared")
    met = (
        shared.join(sets.select("rep", "sketch"), "rep").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
            "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            F.expr("CASE WHEN block = other THEN 0 WHEN block < other THEN 1 ELSE 2 END").alias("side"), "rep", "sketch"))
    survived = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side").mapInArrow(
        _survivors(needed), "rep long, label long")
    candidates = components(materialise(survived.distinct(), "survivors"), "rep", "label")

    reps = sets.select("rep", "weight", "size").distinct()
    grouped = materialise(candidates.withColumnRenamed("node", "rep").join(reps, "rep"), "grouped")
    wanted = grouped.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("size") / TILE_GRAMS)).cast("int").alias("blocks"))
    bundles = max(1, math.ceil((grouped.agg(F.sum("size")).first()[0] or 0) / BUNDLE_GRAMS))
    members = (
        # by sort and merge at every size: the members grow with the documents, so a broadcast would not last
        source.join(grouped.join(wanted, "root").withColumnRenamed("rep", "id").hint("merge"), "id")
        .select(F.col("id").alias("rep"), "root", "weight", "blocks", "text")
        .mapInArrow(_sets(n), "rep long, root long, weight long, blocks int, grams binary, signature binary")
        .withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    )
    tiles = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        F.expr(f"if(blocks = 1, -1 - pmod(xxhash64(root), {bundles}), root)").alias("group"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") == F.col("other")).alias("inner"), "root", "block", "rep", "weight", "grams", "signature")
    found = materialise(
        tiles.groupBy("group", "low", "high").applyInArrow(
            _verify(threshold, needed), "rep long, links long, label long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "label").withColumnRenamed("node", "rep")
    # the copies of a set are dealt to one part for every COPIES of them, and each part gets the set's row
    parts = F.ceil(F.col("weight") / COPIES).cast("int")
    rows = sets.groupBy("rep").agg(F.max("weight").alias("weight")).join(links.join(roots, "rep", "left"), "rep", "left").select(
        "rep", "links", "root", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    known = classed.select("id", "rep", "weight", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")).join(
        rows, ["rep", "part"]).select(
        F.col("id").alias(id), F.coalesce("root", "rep").alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = sketch.where("size = 0").select(F.col("id").alias(id), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    unnamed = source.where("id IS NULL").select(
        F.col("id").alias(id), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone).unionByName(unnamed)


def without_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose id is that of their class, one row each; rows with a null id stay.

    Of equal texts without words, null counting as empty, the one with the smallest id stays.
    """
    named, worded = docs.where(F.col(id).isNotNull()), F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    filled = named.where(worded)
    kept = similarity_classes(filled, id, text, **options).where(F.col(id) == F.col("class_id")).select(id).distinct()
    blank = named.where(~worded).withColumn("_blank", F.coalesce(text, F.lit("")))
    firsts = blank.groupBy("_blank").agg(F.min(id).alias(id))
    return filled.join(kept, id, "left_semi").dropDuplicates([id, text]).select(docs.columns).unionByName(
        blank.join(firsts, [id, "_blank"], "left_semi").dropDuplicates([id, "_blank"]).select(docs.columns),
    ).unionByName(docs.where(F.col(id).isNull()))
