"""Benchmark decontamination: word-pair seeds counted by window, and Smith-Waterman alignment.

The benchmark is a stated query set, read in blocks of bounded size; each block is
held against all documents.  The score is the local alignment score over the item's highest
possible one: 1 for a whole copy, at least one half for copies with up to about a third of
the words replaced, inserted or left out.

Seeds lose no such alignment.  Of an item of ``m`` words an alignment with ``M`` matches and
``E`` edits scores ``2 M - E``.  Count two for each two successive matches without an edit
between them and one for those with a single edit: the sum is at least the score less
two.  Both kinds are pairs of words that stand in the document next to each other or
with one word between, as in the item, so they are looked up as such.  The quarter of an item's
pair starts that the corpus holds most often is not looked up and taken off the sum in
full; a document is aligned wherever a stretch as long as an alignment can be reaches the rest.

Defined cases: a null or empty text has no words and matches nothing; an item of
fewer than three words is matched as a whole; null ids are passed through;
repeated documents or items are each reported; words are runs of ASCII letters and digits
(lower-cased) and non-ASCII characters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import hash_ngrams, hash_words, mix, text_chunks

SHORT = 2
BLOCK_BYTES = 4_000_000
MATCH, MISS, GAP = 2, 1, 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score with linear gaps and the end of its alignment in ``window``."""
    slope = GAP * np.arange(len(window) + 1)
    above, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        row = np.maximum(0, above - GAP)
        np.maximum(row[1:], above[:-1] + np.where(window == word, MATCH, -MISS), out=row[1:])
        above = np.maximum.accumulate(row + slope) - slope
        k = int(above.argmax())
        if above[k] > best:
            best, end = int(above[k]), k
    return best, end


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word and the one ``apart`` places after it, the same whatever the distance."""
    return mix(words[:-apart] * _PAIR + words[apart:])


def _words_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return hash_words(data, np.array([0, len(data)]))[0]


class _Lookup:
    """Membership of 64-bit numbers in a sorted array, with a bit table in front of the binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, int(len(keys)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[keys >> np.uint64(64 - self.bits)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` that hold a key, and the keys' positions."""
        at = np.flatnonzero(self.table[values >> np.uint64(64 - self.bits)])
        k = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        hit = self.keys[k] == values[at]
        return at[hit], k[hit]


def _hits(texts: pa.Array, lookup: _Lookup):
    """By chunk: ``(first row, words, first word of each row, and row, word position, key position, kind of each hit)``.

    Kinds: 0 for words next to each other, 1 for those with a word between, 2 for whole items of one or two words.
    """
    for start, stop, data, offsets in text_chunks(texts):
        words, first = hash_words(data, offsets)
        found = []
        for kind, length, hashes in (
            (0, 2, _pairs(words, 1)), (1, 3, _pairs(words, 2)), (2, 1, hash_ngrams(words, 1)), (2, 2, hash_ngrams(words, 2))):
            at, key = lookup.find(hashes)
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + length <= first[row + 1]
            found.append((row[inside], at[inside], key[inside], np.full(int(inside.sum()), kind)))
        yield start, words, first, *(np.concatenate(x) for x in zip(*found))


def _count(lookup: _Lookup):
    def run(batches):
        counts = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for _, _, _, row, _, key, _ in _hits(batch.column(0), lookup):
                once = np.unique(row * len(counts) + key)
                counts += np.bincount(once % len(counts), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch({"key": pa.array(at.astype(np.int64)), "n": pa.array(counts[at])})
    return run


class _Seeds:
    """What each looked-up key stands for: ``(item, kind)`` lists by key, and by item the sum that a window needs."""

    def __init__(self, items, lookup: _Lookup, counts: np.ndarray, least: float):
        keys, owners, kinds = [], [], []
        self.needed, self.window = np.ones(len(items), np.int64), np.zeros(len(items), np.int64)
        for k, (_, words) in enumerate(items):
            size = len(words)
            # an alignment that reaches the least score holds at most so many words of the document
            self.window[k] = size + max(0, math.floor(MATCH * size * (1 - least) + 1e-9))
            if size <= SHORT:
                keys.append(hash_ngrams(words, size))
                owners.append(k)
                kinds.append(2)
                continue
            near, far = _pairs(words, 1), _pairs(words, 2)
            often = counts[np.searchsorted(lookup.keys, near)]
            often[:-1] += counts[np.searchsorted(lookup.keys, far)]
            needed = math.ceil(MATCH * size * least - 1e-9) - 2
            left_out = max(0, min((size - 1) // 4, (needed - 1) // 2))
            self.needed[k] = max(1, needed - 2 * left_out)
            looked = np.ones(size - 1, bool)
            looked[np.argsort(-often, kind="stable")[:left_out]] = False
            for kind, hashes in ((0, near[looked]), (1, far[looked[:-1]])):
                keys.append(np.unique(hashes))
                owners.append(k)
                kinds.append(kind)
        sizes = [len(x) for x in keys]
        hashes = np.concatenate(keys)
        owner, kind = np.repeat(np.array(owners, np.int64), sizes), np.repeat(np.array(kinds, np.int64), sizes)
        order = np.argsort(hashes, kind="stable")
        self.lookup = _Lookup(np.unique(hashes))
        self.owner, self.kind = owner[order], kind[order]
        self.first = np.searchsorted(hashes[order], np.append(self.lookup.keys, np.uint64(2**64 - 1)))
        self.first[-1] = len(hashes)

    def spans(self, first, row, at, key, kind):
        """``(row, item, low, high)``: words of the chunk to align, of each item and row in order, without overlaps."""
        many = self.first[key + 1] - self.first[key]
        place = np.repeat(self.first[key] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        row, at, kind, item, as_kind = *(np.repeat(x, many) for x in (row, at, kind)), self.owner[place], self.kind[place]
        fits = (kind == 2) == (as_kind == 2)
        row, at, kind, item, as_kind = (x[fits] for x in (row, at, kind, item, as_kind))
        weight = np.where((kind == 0) & (as_kind == 0), 2, 1)
        base = int(first[-1]) + 1
        place = item * base + at
        order = np.argsort(place, kind="stable")
        row, at, item, place = row[order], at[order], item[order], place[order]
        sums = np.concatenate([[0], np.cumsum(weight[order])])
        end = np.searchsorted(place, item * base + np.minimum(at + self.window[item], first[row + 1]))
        enough = sums[end] - sums[np.searchsorted(place, place)] >= self.needed[item]
        last = None
        for r, k, a in zip(row[enough].tolist(), item[enough].tolist(), at[enough].tolist()):
            low, high = max(int(first[r]), a - int(self.window[k])), min(int(first[r + 1]), a + int(self.window[k]))
            if last is not None and last[:2] == (r, k) and low <= last[3]:
                last = (r, k, last[2], high)
                continue
            if last is not None:
                yield last
            last = (r, k, low, high)
        if last is not None:
            yield last


def _align_all(items, seeds: _Seeds, least: float):
    def run(batches):
        for batch in batches:
            known, out = {}, []
            for start, words, first, *hits in _hits(batch.column(1), seeds.lookup):
                found = {}
                for row, item, low, high in seeds.spans(first, *hits):
                    item_words, window = items[item][1], words[low:high]
                    cached = known.get((item, window.tobytes()))
                    if cached is None:
                        score, end = align(item_words, window)
                        score /= MATCH * len(item_words)
                        begin = end - align(item_words[::-1], window[:end][::-1])[1] if score >= least else 0
                        cached = known[item, window.tobytes()] = score, begin, end
                    score, begin, end = cached
                    low -= int(first[row])
                    found[row, item] = max(found.get((row, item), (0.0, 0, 0)), (score, -(low + begin), low + end))
                out += [
                    (start + row, items[item][0], best[0], -best[1], best[2] - 1)
                    for (row, item), best in found.items() if best[0] >= least]
            rows, names, scores, begins, ends = zip(*out) if out else [()] * 5
            yield pa.record_batch({
                "doc": batch.column(0).take(pa.array(rows, pa.int64())), "item": pa.array(names, pa.int64()),
                "score": pa.array(scores, pa.float64()), "first_word": pa.array(begins, pa.int64()),
                "last_word": pa.array(ends, pa.int64())})
    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", least: float = 0.5, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, item, score, first_word, last_word)`` of every document and item that align with ``score >= least``.

    Of several alignments of a pair the best one is returned, the first if they tie.
    """
    source = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    queries = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = "doc long, item long, score double, first_word long, last_word long"
    found = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        items = [(r["item"], w) for r in rows if len(w := _words_of(r["text"]))]
        if not items:
            continue
        grams = [x for _, w in items if len(w) > SHORT for x in (_pairs(w, 1), _pairs(w, 2))]
        lookup = _Lookup(np.unique(np.concatenate([np.zeros(1, np.uint64), *grams])))
        counts = np.zeros(len(lookup.keys), np.int64)
        for r in source.select("text").mapInArrow(_count(lookup), "key long, n long").groupBy("key").agg(
                F.sum("n").alias("n")).collect():
            counts[r["key"]] = r["n"]
        part = source.mapInArrow(_align_all(items, _Seeds(items, lookup, counts, least), least), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = source.select("doc", F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("score"),
                              F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("last_word")).where("false")
    return found.withColumnsRenamed({"doc": id, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The documents without an aligned benchmark item; those with a null id are kept."""
    return docs.join(contaminated(docs, benchmark, id, **options).select(id).distinct(), id, "left_anti")
