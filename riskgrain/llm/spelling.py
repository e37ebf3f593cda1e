"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word's letters are counted; one edit moves the count vector by a squared distance of at
most two (two for a replaced letter, one for a letter more or less).  Squared distances of a block of
words are one matrix product of their counts, ``|a|^2 + |b|^2 - 2 a.b``; pairs at most two are kept and
their edit is verified letter by letter.

Only words of equal or adjacent length meet.  Comparing whole lengths would grow with the square of the
vocabulary, so a length's words are cut into blocks that lose no pair: letters are dealt into
``GROUPS`` groups.  A replaced letter touches at most two groups, so the words agree in the
counts of all others and meet in the block of those counts and their length; a letter more or less touches
one group, and the words meet in the block of the counts of all others, whatever their length.
A pair is taken from one block only: that of the first two groups that hold all it touches.

Blocks with few words are multiplied in batches; those of more than ``TILE`` words are cut into tiles,
each pair of tiles a task's work.  A task returns counts and best neighbours, never its pairs.

Defined cases: a null text has no words, a null id counts as empty in the hash; words below ``least`` letters after
the deletion or below ``times`` occurrences are left out; equal words are one.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .line_dedup import ascii_lower
from .words import mix

#: Letters, after A-Z are lower-cased: a to z and U+00C0 to U+00FF.
RUN = "[a-z\u00C0-\u00FF]+"
FIRST, LAST = 0xC0, 0xFF
LETTERS = 26 + LAST - FIRST + 1
GROUPS, TILE = 6, 1_024
#: Words up to this length are compared as rows of a matrix, longer ones one by one.
SHORT = 64
#: Rows judged at once.
ROWS = 40_000
#: Entries of a matrix product.
CELLS = 4_000_000


def runs_of(id: Column, text: Column, least: int) -> Column:
    """The text's runs of letters, A-Z lower-cased, one letter deleted where 31 divides the hash of id and run."""
    def changed(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    lower = ascii_lower(F.coalesce(text, F.lit("")))
    long = F.filter(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0)), lambda run: F.length(run) >= least)
    return F.filter(F.transform(long, changed), lambda run: F.length(run) >= least)


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, times: int = 2) -> DataFrame:
    """``(word, n)``."""
    return docs.select(F.explode(runs_of(F.col(id), F.col(text), least)).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= times)


def _numbers(texts: np.ndarray) -> np.ndarray:
    """Letters as numbers from 1, a row for each word, filled up with 0."""
    points = texts.view(np.uint32).reshape(len(texts), -1).astype(np.int32)
    return np.where(points == 0, 0, np.where(points < FIRST, points - ord("a") + 1, points - FIRST + 27)).astype(np.uint8)


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each letter occurs in each word."""
    counts = np.zeros((len(words), LETTERS + 1), np.int64)
    sizes = np.array([len(w) for w in words])
    short = np.flatnonzero(sizes <= SHORT)
    if len(short):
        for column in _numbers(np.array([words[k] for k in short])).T:
            counts[short, column] += 1
    for k in np.flatnonzero(sizes > SHORT):
        counts[k] = np.bincount(_numbers(np.array([words[k]]))[0], minlength=LETTERS + 1)
    return counts[:, 1:]


def letter_groups(totals: np.ndarray, groups: int) -> np.ndarray:
    """A group of every letter, there and back in the order of how often they occur."""
    order, out = np.argsort(-totals, kind="stable"), np.zeros(len(totals), np.int64)
    turn = np.arange(len(totals)) % (2 * groups)
    out[order] = np.minimum(turn, 2 * groups - 1 - turn)
    return out


_WEIGHTS = mix(np.arange(1, LETTERS + 1, dtype=np.uint64))


def _group_sums(counts: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One number for the counts of each group's letters."""
    weighted = counts.astype(np.uint64) * _WEIGHTS
    return mix(np.stack([weighted[:, group == g].sum(axis=1) for g in range(groups)], axis=1))


def block_keys(counts: np.ndarray, lengths: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One key for every pair of groups left out (equal lengths), then for every single one (adjacent lengths)."""
    sums, keys = _group_sums(counts, group, groups), []
    whole = sums.sum(axis=1)
    for k, (a, b) in enumerate(itertools.combinations(range(groups), 2)):
        keys.append(mix((whole - sums[:, a] - sums[:, b]) ^ mix((lengths * 64 + k + 1).astype(np.uint64))))
    for a in range(groups):
        keys.append(mix((whole - sums[:, a]) ^ mix(np.full(len(sums), 1_000_003 + a, np.uint64))))
    return np.stack(keys, axis=1).view(np.int64)


def one_edit(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows of letter numbers differs by exactly one inserted, deleted or replaced letter."""
    swap = (size_a > size_b)[:, None]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    differ = short != long
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), short.shape[1])
    # behind the first difference the longer word goes on as the shorter one from there
    later = np.arange(short.shape[1] - 1) >= first[:, None]
    shifted = ((short[:, :-1] != long[:, 1:]) & later).any(axis=1)
    return np.where(size_a == size_b, differ.sum(axis=1) == 1, (abs(size_a - size_b) == 1) & ~shifted)


def one_edit_text(a: str, b: str) -> bool:
    """The same of two words."""
    a, b = sorted((a, b), key=len)
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and a[head + (len(a) == len(b)):] == b[head + 1:]


class _Words:
    """Words of a task, encoded once."""

    def __init__(self, words: list[str], n: np.ndarray, group: np.ndarray, groups: int):
        self.words, self.n = words, n
        self.lengths = np.array([len(w) for w in words])
        # a column more than the longest has, for the shift by one letter
        widest = max((len(w) for w in words if len(w) <= SHORT), default=0) + 1
        self.codes = _numbers(np.array([w if len(w) <= SHORT else "" for w in words], dtype=f"U{widest}"))
        counts = letter_counts(words)
        self.sums = _group_sums(counts, group, groups)
        # single precision holds these products exactly as long as they stay below 2 ** 24
        self.counts = counts.astype(np.float32 if self.lengths.max() < 2_000 else np.float64)
        self.squares = (self.counts ** 2).sum(axis=1)
        self.pairs = list(itertools.combinations(range(groups), 2))

    def near(self, i: np.ndarray, j: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs at squared distance of at most two, those of one edit that belong to blocks of this kind."""
        size_i, size_j = self.lengths[i], self.lengths[j]
        fits = size_i == size_j if kind < len(self.pairs) else abs(size_i - size_j) == 1
        i, j = i[fits], j[fits]
        edits = one_edit(self.codes[i], self.codes[j], self.lengths[i], self.lengths[j])
        for k in np.flatnonzero((self.lengths[i] > SHORT) | (self.lengths[j] > SHORT)):
            edits[k] = one_edit_text(self.words[i[k]], self.words[j[k]])
        i, j = i[edits], j[edits]
        if kind < len(self.pairs):
            # the first pair of groups that holds all touched ones
            touched = self.sums[i] != self.sums[j]
            holds = np.stack([touched.sum(axis=1) == touched[:, a].astype(int) + touched[:, b] for a, b in self.pairs], axis=1)
            own = holds.argmax(axis=1) == kind
            i, j = i[own], j[own]
        return i, j


def close_pairs(counts: np.ndarray, squares: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at squared distance of at most two: rows ``left`` against rows ``right`` of a block."""
    found = []
    step = max(1, CELLS // max(1, len(right)))
    for a in range(0, len(left), step):
        part = left[a:a + step]
        distance = squares[part][:, None] + squares[right][None, :] - 2 * (counts[part] @ counts[right].T)
        i, j = np.nonzero(distance <= 2)
        if same:
            i, j = i[i + a < j], j[i + a < j]
        found.append((part[i], right[j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _small_blocks(counts: np.ndarray, squares: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Pairs at squared distance of at most two inside blocks of up to 64 rows, multiplied in batches of like size."""
    width = 1 << np.maximum(1, np.ceil(np.log2(sizes)).astype(int))
    for w in np.unique(width):
        at, step = np.flatnonzero(width == w), max(1, CELLS // int(w * max(w, LETTERS)))
        for a in range(0, len(at), step):
            blocks = at[a:a + step]
            rows = starts[blocks][:, None] + np.minimum(np.arange(w), sizes[blocks][:, None] - 1)
            real = np.arange(w) < sizes[blocks][:, None]
            gram = counts[rows] @ counts[rows].transpose(0, 2, 1)
            distance = squares[rows][:, :, None] + squares[rows][:, None, :] - 2 * gram
            good = (distance <= 2) & real[:, :, None] & real[:, None, :] & np.triu(np.ones((w, w), bool), 1)
            b, i, j = np.nonzero(good)
            yield rows[b, i], rows[b, j], blocks[b]


def _tiles(group: np.ndarray, groups: int):
    """Rows by block, kind and tile: counts of near words and the best of them for each word of a task."""
    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            marks = mark(table)
            last = int(np.flatnonzero(marks != marks[-1])[-1]) + 1 if (marks != marks[-1]).any() else 0
            # whole blocks only; a block's rows are bounded
            if last and len(table) >= ROWS:
                yield from judged(table.slice(0, last), marks[:last])
                table = table.slice(last)
            carry = table
        if carry is not None and len(carry):
            yield from judged(carry, mark(carry))

    def mark(table: pa.Table) -> np.ndarray:
        key, tile = table["key"].to_numpy(), table["tile"].to_numpy()
        change = np.zeros(len(table), np.int64)
        change[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        return np.cumsum(change)

    def judged(table: pa.Table, marks: np.ndarray):
        words = table["word"].combine_chunks().dictionary_encode()
        row = words.indices.to_numpy()
        _, first = np.unique(row, return_index=True)
        here = _Words(words.dictionary.to_pylist(), table["n"].to_numpy()[first], group, groups)
        counts, squares = here.counts[row], here.squares[row]
        kinds, sides = table["kind"].to_numpy(), table["side"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(marks)]]))
        inner = np.array([sides[s] == 0 for s in starts])
        found = []
        small = np.flatnonzero(inner & (sizes <= 64))
        for i, j, block in _small_blocks(counts, squares, starts[small], sizes[small]):
            found.append((i, j, kinds[starts[small][block]]))
        for k in np.flatnonzero(~inner | (sizes > 64)):
            rows = np.arange(starts[k], starts[k] + sizes[k])
            left, right = (rows, rows) if inner[k] else (rows[sides[rows] == 1], rows[sides[rows] == 2])
            if len(left) and len(right):
                i, j = close_pairs(counts, squares, left, right, inner[k])
                found.append((i, j, np.full(len(i), kinds[starts[k]])))
        i, j, kind = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        pairs = [here.near(row[i[at]], row[j[at]], int(k)) for k in np.unique(kind) for at in pieces(np.flatnonzero(kind == k))]
        if not pairs:
            return
        a = np.concatenate([p[0] for p in pairs] + [p[1] for p in pairs])
        b = np.concatenate([p[1] for p in pairs] + [p[0] for p in pairs])
        if not len(a):
            return
        # the best neighbour occurs most often, and then comes first in the order of code points
        rank = np.empty(len(here.words), np.int64)
        rank[sorted(range(len(here.words)), key=here.words.__getitem__)] = np.arange(len(here.words))
        order = np.lexsort((rank[b], -here.n[b], a))
        a, b = a[order], b[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
        yield pa.record_batch({
            "word": words.dictionary.take(pa.array(a[at])), "n_near": pa.array(np.diff(np.concatenate([at, [len(a)]]))),
            "best": words.dictionary.take(pa.array(b[at])), "best_n": pa.array(here.n[b[at]])})

    def pieces(at: np.ndarray):
        return np.array_split(at, max(1, -(-len(at) // 200_000)))

    return run


def _keys(group: np.ndarray, groups: int):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            keys = block_keys(letter_counts(words), np.array([len(w) for w in words], np.int64), group, groups)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch({"word": batch.column("word"), "n": batch.column("n"), "keys": lists})
    return run


def _letter_totals(words: DataFrame) -> np.ndarray:
    """How often each letter occurs in the words: one row for each letter there is."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    totals = np.zeros(LETTERS)
    for letter, n in letters.groupBy("letter").count().collect():
        totals[ord(letter) - ord("a") if ord(letter) < FIRST else ord(letter) - FIRST + 26] = n
    return totals


def near_words(words: DataFrame, groups: int = GROUPS, tile: int = TILE) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the words ``(word, n)`` that have a near one."""
    group = letter_groups(_letter_totals(words), groups)
    keyed = words.mapInArrow(_keys(group, groups), "word string, n long, keys array<long>").select(
        "word", "n", F.posexplode("keys").alias("kind", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn(
        "tiles", F.ceil(F.col("size") / tile).cast("int"))
    met = keyed.join(sizes, "key").withColumn("own", F.expr("cast(pmod(xxhash64(word), tiles) as int)"))
    # tiles of a block meet pairwise; side 0: inside a tile
    pairs = met.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "key", "kind", "word", "n", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("tile"),
        F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side"))
    best = pairs.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(
        _tiles(group, groups), "word string, n_near long, best string, best_n long")
    return best.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rarity"), "best")).alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.rarity")).alias("best_n"))


def variants(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, ratio: int = 10, groups: int = GROUPS, tile: int = TILE,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: one row per word; its form is its commonest near word if ``ratio`` times as common."""
    words = materialise(vocabulary(docs, id, text, least, times), "vocabulary")
    near = near_words(words, groups, tile)
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best")).alias("form"),
        F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    # a form is ``ratio`` times as common, so chains are short: each round doubles what they reach
    links = materialise(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialise(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
