"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased.  Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
their lines but those of the largest id that holds them.

Documents are taken in batches of falling id.  The keys of a batch are merge-joined
with the runs so far: a key in none of them is new, and its largest id in the batch
owns it for good; a known key only adds to its count.  The batch is then written as a
run of its own, bucketed and sorted by key.  ``FANOUT`` runs of a level are merged into
one run of the next, all without a shuffle, as runs share their buckets.  What remains
at the end is merged once more and holds every key's count and owner.  A batch's run holds its known
keys too, with their counts, so that merging adds counts up.

Defined cases: null or empty text is one empty line; rows with a null id are not counted and keep all lines;
rows that share an id are one document for the counts, and each is returned without the lines it loses;
columns of the input are kept, but those named like a result are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise, scratch_path

BATCHES, FANOUT = 4, 2
BLANK = " \t\n\x0b\x0c\r"
KEY = ["h", "g"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased, all else as it is; the plain function is faster and does the same to ASCII."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def key_hash(key: Column) -> Column:
    """96 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (stem + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for stem in stems]


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def by_hash(keys: Column) -> Column:
    """Key hashes dealt into about as many lists as each then holds, so that a very long text does not search them all for each line."""
    lists = F.ceil(F.sqrt(F.size(keys).cast("double"))).cast("int")
    return F.when(F.size(keys) > 0, F.transform(F.sequence(F.lit(0), lists - 1), lambda k: F.filter(
        keys, lambda key: F.pmod(key["h"], lists) == k)))


def held(lists: Column, key: Column) -> Column:
    return F.array_contains(F.get(lists, F.pmod(key["h"], F.size(lists)).cast("int")), key)


class LineRuns:
    """Runs ``(h, g, n, owner)`` by level; ``add`` takes the ids of each batch below those of the batches before."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        run.select(*KEY, "n", "owner").repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option(
            "path", scratch_path(self.spark, "runs")).saveAsTable(name)
        stored = self.spark.table(name)
        stored.schema  # resolved now, so that only the files are needed from here on
        self.spark.sql(f"DROP TABLE {name}")
        return stored

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.alias("a"), b.withColumnsRenamed({"n": "m", "owner": "other"})
        return a.join(b, KEY, "full_outer").select(
            *KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("owner", "other").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """``batch``: ``(h, g, doc)``, one row for each document and key."""
        counts = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        known = F.lit(False)
        for k, run in enumerate(r for level in self.levels for r in level):
            counts = counts.join(run.select(*KEY, F.lit(True).alias(f"in{k}")), KEY, "left")
            known = known | F.coalesce(f"in{k}", F.lit(False))
        run, level = self._write(counts.withColumn("owner", F.when(~known, F.col("last")))), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            first, *rest = self.levels[level]
            for other in rest:
                first = self._merge(first, other)
            run, self.levels[level], level = self._write(first), [], level + 1

    def merged(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        whole = runs[0]
        for run in runs[1:]:
            whole = self._merge(whole, run)
        return whole


def deduplicate_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES,
    fanout: int = FANOUT, counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the kept lines in ``text`` and with two counts: lines before, and dropped ones."""
    spark = docs.sparkSession
    hashes = F.array_distinct(F.transform(
        F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.length(k) >= min_chars), key_hash))
    ids = docs.select(F.col(id).cast("long").alias("doc"))
    shares = [1 - (k + 1) / batches for k in range(batches - 1)]
    cuts = ids.agg(F.percentile_approx("doc", shares).alias("cuts")).first()["cuts"] if shares else None
    cuts = sorted(set(cuts or []), reverse=True)
    number = sum([F.when(F.col("doc") <= c, 1).otherwise(0) for c in cuts], F.lit(0))
    # rows that share an id may share lines
    lines = materialise(
        docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.explode(hashes).alias("k"))
        .select("doc", "k.h", "k.g").distinct().withColumn("batch", number), "lines")

    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for k in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == k))
    # written first, so that the join shuffles both sides anew and the documents of a very common line can be split
    frequent = materialise(runs.merged().where(F.col("n") >= min_docs).select(*KEY, "owner"), "frequent")
    drops = (
        lines.join(frequent, KEY).where(F.col("doc") != F.col("owner"))
        .groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias("_drops")))

    n_lines, n_dropped = counts
    source = docs.drop(*counts)
    doc, gone, rest = fresh(source, "_doc", "_drops", "_kept")
    kept = bound(by_hash(F.col(gone)), lambda lists: F.filter(lines_of(F.col(text)), lambda line: ~(
        (F.length(line_key(line)) >= min_chars) & held(lists, key_hash(line_key(line))))))
    some = F.col(gone).isNotNull()
    joined = source.join(drops.withColumnsRenamed({"doc": doc, "_drops": gone}).hint("merge"), F.col(id) == F.col(doc), "left")
    counted = joined.withColumn(n_lines, F.size(lines_of(F.col(text))).cast("long")).withColumn(rest, F.when(some, kept))
    return counted.withColumn(n_dropped, F.when(some, F.col(n_lines) - F.size(rest)).otherwise(0).cast("long")).withColumn(
        text, F.when(some, F.array_join(rest, "\n")).otherwise(F.coalesce(F.col(text), F.lit("")))).drop(doc, gone, rest)
