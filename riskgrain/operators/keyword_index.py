"""Many keywords at once: words found through their rarest grams.

A word is posted under one run of up to three of its bytes, the one that occurs least in the texts.
A text's grams are looked up in a table of the posted ones; only where one stands is the word compared, byte by
byte.  So the work follows the text, and not words times text.  UTF-8 bytes of a word
match only whole characters, so bytes and characters give the same places.

The words come with the call, like those of ``keywords``; the index travels with the tasks.
Null texts hold no word; the empty word is in every other text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

GRAM = 3
#: Cells in which grams are counted to find rare ones; collisions only cost time.
CELLS = 1 << 16
#: Bytes of text searched at once.
CHUNK = 1 << 20
#: Candidates compared at once.
COMPARED = 200_000


def gram_codes(data: np.ndarray, size: int) -> np.ndarray:
    """The number of the ``size`` bytes from each byte on, and of a shorter run at the end of the data."""
    codes = np.zeros(len(data), np.uint32)
    for k in range(size):
        codes[:len(data) - k] += data[k:].astype(np.uint32) << np.uint32(8 * k)
    return codes


def _cell(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(16)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, row offsets into them)`` of about ``CHUNK`` bytes of texts at a time."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1)
        yield start, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        start = stop


def gram_counts(df: DataFrame, text: str) -> np.ndarray:
    """How often the three-byte grams of each cell occur in the texts."""
    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, data, _ in _chunks(batch.column("text")):
                for start in range(0, len(data), CHUNK):
                    codes = gram_codes(data[start:start + CHUNK + GRAM - 1], GRAM)[:CHUNK]
                    counts += np.bincount(_cell(codes), minlength=CELLS)
        at = np.flatnonzero(counts)
        yield pa.record_batch({"cell": pa.array(at), "n": pa.array(counts[at])})

    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "cell long, n long")
    out = np.zeros(CELLS, np.int64)
    for cell, n in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    return out


@dataclass
class WordIndex:
    """Posted grams by size: sorted ``codes`` with the words ``word`` and the places ``place`` of the gram in them."""

    words: list[bytes]
    posted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, words: Sequence[str], counts: np.ndarray | None = None) -> WordIndex:
        plain, lists = [w.encode() for w in words], {}
        for k, word in enumerate(plain):
            size = min(GRAM, len(word))
            if not size:
                continue
            codes = gram_codes(np.frombuffer(word, np.uint8), size)[:len(word) - size + 1]
            best = int(np.argmin(counts[_cell(codes)])) if counts is not None and size == GRAM else 0
            lists.setdefault(size, []).append((int(codes[best]), k, best))
        posted = {}
        for size, entries in lists.items():
            code, word, place = (np.array(c, np.int64) for c in zip(*sorted(entries)))
            posted[size] = code.astype(np.uint32), word, place
        return cls(plain, posted)

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(row, word)`` of every word in every text, once each, in order."""
        parts = [(row + first, word) for first, _, row, word in self.searched(texts)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, words = zip(*parts)
        return np.concatenate(rows), np.concatenate(words)

    def searched(self, texts: pa.Array, tables: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, rows, row, word)`` chunk by chunk, rows counted from the first, each word in a text once, in order."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        letters = np.frombuffer(b"".join(self.words), np.uint8)
        tables = tables or self.tables()
        empty = np.flatnonzero(sizes == 0)
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        for first, data, offsets in _chunks(texts):
            n_rows, codes = len(offsets) - 1, [np.empty(0, np.int64)]
            # a long text is searched piece by piece
            for start in range(0, len(data), CHUNK):
                row, word = self._hits(data, offsets, start, tables, sizes, starts, letters)
                codes.append(np.unique(row * len(self.words) + word))
            if len(empty):
                some = np.flatnonzero(valid[first:first + n_rows])
                codes.append((some[:, None] * len(self.words) + empty).ravel())
            pairs = np.unique(np.concatenate(codes))
            yield first, n_rows, pairs // max(1, len(self.words)), pairs % max(1, len(self.words))

    def _hits(self, data, offsets, start, tables, sizes, starts, letters) -> tuple[np.ndarray, np.ndarray]:
        """``(row, word)`` for the posted grams that begin in ``CHUNK`` bytes from ``start`` on."""
        rows, words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, (codes, word, place) in self.posted.items():
            here = gram_codes(data[start:start + CHUNK + size - 1], size)[:CHUNK]
            at = np.flatnonzero(tables[size][here])
            low, high = np.searchsorted(codes, here[at], "left"), np.searchsorted(codes, here[at], "right")
            at += start
            for part in _pieces(high - low):
                n = (high - low)[part]
                entry = np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = word[entry]
                begin = np.repeat(at[part], n) - place[entry]
                row = np.searchsorted(offsets, np.repeat(at[part], n), side="right") - 1
                inside = (begin >= offsets[row]) & (begin + sizes[w] <= offsets[row + 1])
                w, begin, row = w[inside], begin[inside], row[inside]
                for length in np.unique(sizes[w]):
                    same = np.flatnonzero(sizes[w] == length)
                    for a in range(0, len(same), max(1, COMPARED // int(length))):
                        few = same[a:a + max(1, COMPARED // int(length))]
                        along = np.arange(length)
                        equal = (data[begin[few][:, None] + along] == letters[starts[w[few]][:, None] + along]).all(axis=1)
                        rows.append(row[few][equal])
                        words.append(w[few][equal])
        return np.concatenate(rows), np.concatenate(words)

    def tables(self) -> dict[int, np.ndarray]:
        """By size, which grams are posted."""
        return {size: self._table(size, codes) for size, (codes, _, _) in self.posted.items()}

    @staticmethod
    def _table(size: int, codes: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << (8 * size), bool)
        table[codes] = True
        return table


def _pieces(counts: np.ndarray) -> Iterator[slice]:
    """Runs of entries of about ``COMPARED`` candidates."""
    reach, start = np.cumsum(counts), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + COMPARED, side="right")))
        yield slice(start, stop)
        start = stop


def word_index(df: DataFrame, text: str, words: Sequence[str]) -> WordIndex:
    """An index of ``words`` by the grams that are rare in the texts of ``df``; one scan of them."""
    return WordIndex.of(words, gram_counts(df, text))


def present_words(df: DataFrame, text: str, words: Sequence[str], keep: Sequence[str] = (), index: WordIndex | None = None, out: str = "present") -> DataFrame:
    """The kept columns and, in ``out``, the ascending positions in ``words`` of those that the text holds."""
    index = index or word_index(df, text, words)
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches):
        tables = index.tables()
        for batch in batches:
            for first, n, row, word in index.searched(batch.column("_text"), tables):
                ends = np.searchsorted(row, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word, pa.int32()))
                kept = {c: batch.column(c).slice(first, n) for c in batch.schema.names if c != "_text"}
                yield pa.record_batch({**kept, out: lists})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{out}` array<int>"]))


def word_counts(df: DataFrame, text: str, fields: Sequence[str], mark: str, words: Sequence[str], index: WordIndex | None = None) -> DataFrame:
    """``(position, present, marked, f0, f1, ...)`` of the words that occur in ``text``.

    Counted are the rows whose text holds the word, those of them where ``mark``, 0 or 1, is set,
    and those where a field holds the word as well.  Only the sums of a task leave it.
    """
    index = index or word_index(df, text, words)
    columns = list(dict.fromkeys([text, *fields]))
    which = [columns.index(f) for f in fields]
    rows = df.select(F.col(mark).cast("long").alias("_mark"), *[F.col(c).cast("string").alias(f"_c{k}") for k, c in enumerate(columns)])

    def run(batches):
        tables, sums = index.tables(), np.zeros((2 + len(fields), len(words)), np.int64)
        for batch in batches:
            mark = batch.column("_mark").to_numpy(zero_copy_only=False)
            for first, n, row, word in index.searched(batch.column("_c0"), tables):
                found = [row * len(words) + word]
                for k in range(1, len(columns)):
                    parts = index.searched(batch.column(f"_c{k}").slice(first, n), tables)
                    codes = [(r + a) * len(words) + w for a, _, r, w in parts]
                    found.append(np.concatenate(codes) if codes else np.empty(0, np.int64))
                sums[0] += np.bincount(word, minlength=len(words))
                sums[1] += np.bincount(word[mark[first:first + n][row] == 1], minlength=len(words))
                for j, k in enumerate(which):
                    both = word if k == 0 else word[np.isin(found[0], found[k], assume_unique=True)]
                    sums[2 + j] += np.bincount(both, minlength=len(words))
        at = np.flatnonzero(sums[0])
        names = ["present", "marked", *[f"f{j}" for j in range(len(fields))]]
        yield pa.record_batch({"position": pa.array(at, pa.int32()), **{n: pa.array(v[at]) for n, v in zip(names, sums)}})

    names = ["present", "marked", *[f"f{j}" for j in range(len(fields))]]
    counted = rows.mapInArrow(run, ", ".join(["position int", *[f"{n} long" for n in names]]))
    return counted.groupBy("position").agg(*[F.sum(n).alias(n) for n in names])
