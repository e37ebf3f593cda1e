"""Approximate nearest neighbours by cross-polytope hashing.

A vector's direction is turned by pseudo-rotations (three rounds of random signs and a
Hadamard transform) and belongs to the nearest signed axis.  Two rotations make a
bucket: the first one's axis names a tile, the second one's (over half of the axes) a
code inside it.  Each of ``tables`` tables holds every vector once.  A query visits, in
each table, the ``probes`` buckets whose axes lie least behind its own, so it travels
once for each tile with the list of the codes wanted there.  What it meets is ranked
by the distance of the original vectors in double precision.

A task streams a tile's rows past its queries and keeps ``k`` hits for each.  Tiles with
many rows or queries are cut into blocks by id, so neither a common direction nor a
growing table gathers in one task.  Queries that met fewer than ``k`` rows visit every bucket
of one table, that is all rows in blocks; so small tables give whole results.

Recall of the ten nearest with the default parameters, against brute force over all queries, stands
in the README; vectors without any structure are the worst case.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component
and rows without an id take no part; vectors of different lengths never meet.  Rows that share an id are one
candidate, at its nearest row, and one query.  Equal distances go to the smaller id.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialise
from .words import mix

TABLES, PROBES = 8, 640
ROUNDS = 3
#: Rows and queries of a block of a tile; rows are streamed, queries are held.
BLOCK_ROWS, LEAST_ROWS, BLOCK_QUERIES = 262_144, 512, 8_192
#: Rows and queries compared at once.
CHUNK = 2_048

HASHED = "tile string, kind int, code int, codes binary, id long, vec binary"


def usable(vec: Column) -> Column:
    """Vectors that have a direction."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def width(dim: int) -> int:
    """Axes of the rotations: the next power of two, at least 2."""
    return max(2, 1 << (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unscaled Walsh-Hadamard transform of each row."""
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, -1, 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return x


def rotated(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """Unit rows after the pseudo-rotation ``which`` of a table, scaled to unit length; ``which`` 1 keeps half of the axes."""
    axes = width(x.shape[1])
    out = np.zeros((len(x), axes))
    out[:, :x.shape[1]] = x
    signs = np.random.default_rng([table, which, axes]).choice([-1.0, 1.0], (ROUNDS, axes))
    for s in signs:
        out = hadamard(out * s) / np.sqrt(axes)
    return out[:, :axes // (1 + which)]


def nearest_axis(x: np.ndarray) -> np.ndarray:
    """``2 * axis``, plus 1 for its negative end."""
    axis = np.abs(x).argmax(axis=1)
    return 2 * axis + (x[np.arange(len(x)), axis] < 0)


def wanted_buckets(first: np.ndarray, second: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` buckets ``tile * codes + code`` of each row that lie least behind its best one, in ascending order."""
    behind = [(ends.max(axis=1, keepdims=True) - ends) ** 2
              for ends in (np.stack([r, -r], axis=2).reshape(len(r), -1) for r in (first, second))]
    total = (behind[0][:, :, None] + behind[1][:, None, :]).reshape(len(first), -1)
    if probes >= total.shape[1]:
        return np.broadcast_to(np.arange(total.shape[1]), total.shape)
    return np.sort(np.argpartition(total, probes - 1, axis=1)[:, :probes], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, query flags, vectors)`` of a batch's rows, length by length."""
    vecs = batch.column("vec")
    offsets = vecs.offsets.to_numpy()
    values = vecs.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    ids, asked = batch.column("id").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], asked[at], values[offsets[at][:, None] + np.arange(size)].astype(dtype)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    tile, kind, code, codes, ids, vec = zip(*rows)
    return pa.record_batch({
        "tile": pa.array(tile, pa.string()), "kind": pa.array(kind, pa.int32()), "code": pa.array(code, pa.int32()),
        "codes": pa.array(codes, pa.binary()), "id": pa.array(ids, pa.int64()), "vec": pa.array(vec, pa.binary())})


def _hash(dtype: str, tables: int, probes: int, blocks: dict[str, tuple[int, int]] | None):
    """Rows and queries by tile; without ``blocks`` only ``(tile, kind)``, for counting."""
    def run(batches):
        for batch in batches:
            for ids, asked, vecs in _by_length(batch, dtype):
                for a in range(0, len(ids), 512):
                    part = slice(a, a + 512)
                    yield from one(ids[part], np.flatnonzero(asked[part]), vecs[part])

    def one(ids, queries, vecs):
        unit, out = _unit(vecs.astype(np.float64)), []
        spread = mix(ids.astype(np.uint64))
        for table in range(tables):
            first, second = rotated(unit, table, 0), rotated(unit, table, 1)
            tiles, codes = nearest_axis(first), nearest_axis(second)
            stem = f"{vecs.shape[1]}:{table}:"
            for k in range(len(ids)):
                out += emit(f"{stem}{tiles[k]}", 1, int(codes[k]), b"", ids[k], vecs[k], spread[k])
            if not len(queries):
                continue
            found, inner = wanted_buckets(first[queries], second[queries], probes), 2 * second.shape[1]
            for q, buckets in zip(queries, found):
                tile, code = np.divmod(buckets, inner)
                cuts = np.flatnonzero(np.diff(tile)) + 1
                for t, c in zip(tile[np.concatenate([[0], cuts])], np.split(code, cuts)):
                    out += emit(f"{stem}{t}", 0, inner, c.astype("<u4").tobytes(), ids[q], vecs[q], spread[q])
        if blocks is not None:
            yield _records(out)
        else:
            tile, kind = zip(*out)
            yield pa.record_batch({"tile": pa.array(tile, pa.string()), "kind": pa.array(kind, pa.int32())})

    def emit(tile, kind, code, codes, id, vec, spread):
        if blocks is None:
            return [(tile, kind)]
        rows, queries = blocks.get(tile, (1, 1))
        own, others = (queries, rows) if kind == 0 else (rows, queries)
        mine = int(spread % np.uint64(own))
        pairs = [(other, mine) if kind == 0 else (mine, other) for other in range(others)]
        return [(f"{tile}:{r}:{q}", kind, code, codes, id, vec.tobytes()) for r, q in pairs]

    return run


def merged(k: int, queries: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest ids of each query, each id once."""
    order = np.lexsort((distances, ids, queries))
    queries, ids, distances = queries[order], ids[order], distances[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (queries[1:] == queries[:-1]) & (ids[1:] == ids[:-1])
    queries, ids, distances = queries[~again], ids[~again], distances[~again]
    order = np.lexsort((ids, distances, queries))
    queries, ids, distances = queries[order], ids[order], distances[order]
    starts = np.searchsorted(queries, queries, side="left")
    keep = np.arange(len(queries)) - starts < k
    return queries[keep], ids[keep], distances[keep]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def near_pairs(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold each query's ``k`` nearest rows, ties included; rounding is allowed for."""
    qq, xx = (q ** 2).sum(axis=1), (x ** 2).sum(axis=1)
    squares = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
    if len(x) <= k or not np.isfinite(squares).all():
        return tuple(g.ravel() for g in np.indices(squares.shape))
    kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
    return np.nonzero(squares <= (kth + 1e-12 * (qq + xx.max()))[:, None])


class _Tile:
    """The queries of a tile's block and their hits so far."""

    def __init__(self, k: int):
        self.k, self.asked, self.codes, self.vecs = k, [], [], []
        self.hits = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def ask(self, rows: pa.RecordBatch, dtype: str) -> None:
        self.asked.append(rows.column("id").to_numpy())
        self.codes += [np.frombuffer(c, "<u4") for c in rows.column("codes").to_pylist()]
        self.vecs += [np.frombuffer(v, dtype) for v in rows.column("vec").to_pylist()]
        self.inner = rows.column("code")[0].as_py()

    def ready(self) -> None:
        if isinstance(self.asked, list):
            self.asked, self.vecs = np.concatenate(self.asked), np.stack(self.vecs).astype(np.float64)
            self.wants = np.zeros((len(self.asked), self.inner), bool)
            for row, codes in enumerate(self.codes):
                self.wants[row, codes] = True

    def meet(self, rows: pa.RecordBatch, dtype: str) -> None:
        """Rows of ascending code and id."""
        if not len(self.asked):
            return
        self.ready()
        codes, ids = rows.column("code").to_numpy(), rows.column("id").to_numpy()
        raw = np.stack([np.frombuffer(v, dtype) for v in rows.column("vec").to_pylist()])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            queries = np.flatnonzero(self.wants[:, codes[a]])
            if len(queries):
                at = a + first_copies(raw[a:b], self.k + 1)
                for i in range(0, len(at), CHUNK):
                    for j in range(0, len(queries), CHUNK):
                        self.rank(queries[j:j + CHUNK], ids[at[i:i + CHUNK]], raw[at[i:i + CHUNK]].astype(np.float64))

    def rank(self, queries: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        i, j = near_pairs(self.vecs[queries], x, self.k + 1)
        distances = np.concatenate([
            exact(self.vecs[queries[i[s:s + 65536]]], x[j[s:s + 65536]]) for s in range(0, len(i), 65536)])
        other = ids[j] != self.asked[queries[i]]
        found = queries[i][other], ids[j][other], distances[other]
        self.hits = merged(self.k, *(np.concatenate([old, new]) for old, new in zip(self.hits, found)))

    def found(self) -> pa.RecordBatch:
        row, ids, distances = self.hits
        asked = self.asked[row] if len(row) else row
        return pa.record_batch({"query_id": pa.array(asked, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(distances)})


def first_copies(vecs: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` copies of each distinct row: with ascending ids no other copy can be a hit."""
    if len(vecs) <= most:
        return np.arange(len(vecs))
    plain = np.ascontiguousarray(vecs + 0)  # without negative zeros
    _, code = np.unique(plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    nth = np.arange(len(code)) - np.searchsorted(code[order], code[order])
    return np.sort(order[nth < most])


def _search(k: int, dtype: str):
    def run(batches):
        current, tile = None, None
        for batch in batches:
            tiles = batch.column("tile").dictionary_encode()
            marks = tiles.indices.to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1, [len(marks)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = batch.slice(a, b - a)
                name, kind = rows.column("tile")[0].as_py(), rows.column("kind")[0].as_py()
                if name != current:
                    if tile is not None:
                        yield tile.found()
                    current, tile = name, _Tile(k)
                tile.ask(rows, dtype) if kind == 0 else tile.meet(rows, dtype)
        if tile is not None:
            yield tile.found()
    return run


def _blocks(counts: DataFrame) -> dict[str, tuple[int, int]]:
    """Blocks of rows and of queries of the tiles that need more than one: at most two for each axis and table, for each length of vectors."""
    sizes = materialise(counts.groupBy("tile").agg(
        F.count_if(F.col("kind") == 1).alias("rows"), F.count_if(F.col("kind") == 0).alias("queries")), "tiles")
    usual = min(BLOCK_ROWS, max(LEAST_ROWS, math.ceil(2 * (sizes.agg(F.avg("rows")).first()[0] or 0))))
    cut = sizes.withColumn("r", F.ceil(F.col("rows") / usual)).withColumn("q", F.ceil(F.col("queries") / BLOCK_QUERIES))
    return {t: (max(1, r), max(1, q)) for t, r, q in cut.where("r > 1 OR q > 1").select("tile", "r", "q").collect()}


def _hits(points: DataFrame, k: int, tables: int, probes: int, dtype: str) -> DataFrame:
    counts = points.mapInArrow(_hash(dtype, tables, probes, None), "tile string, kind int")
    hashed = points.mapInArrow(_hash(dtype, tables, probes, _blocks(counts)), HASHED)
    # each block's queries come first, then its rows by code and id
    dealt = hashed.repartition("tile").sortWithinPartitions("tile", "kind", "code", "id")
    return dealt.mapInArrow(_search(k, dtype), "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, asked: Column, k: int = 10, id: str = "vec_id", vec: str = "embedding", tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row where ``asked`` holds, itself left out."""
    single = vectors.schema[vec].dataType.simpleString() == "array<float>"
    dtype = "<f4" if single else "<f8"
    points = vectors.select(
        F.col(id).cast("long").alias("id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("vec"),
        F.coalesce(asked, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    found = materialise(ranked(_hits(points, k, tables, probes, dtype)), "neighbours")
    whole = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialise(points.where("asked").select("id").distinct().join(whole, "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    rest = points.drop("asked").join(short.withColumn("more", F.lit(True)), "id", "left").select(
        "id", "vec", F.coalesce("more", F.lit(False)).alias("asked"))
    every = 1 << 62
    again = ranked(_hits(rest, k, 1, every, dtype))
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(again)
