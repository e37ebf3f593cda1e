"""Word and n-gram hashes of whole Arrow text columns, computed with NumPy for a megabyte of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers over all positions."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, UTF-8 bytes, row offsets into them)`` by about a megabyte; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1)
        yield start, stop, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        start = stop


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run of ASCII letters and digits, lower-cased, and non-ASCII characters) and, for each row
    and the end, the index of its first word."""
    size = len(data)
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers = np.full(size, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    powers[:] = _INVERSE
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mix((sums[ends] - sums[begins]) * powers[begins]), np.searchsorted(begins, offsets)


def hash_ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; those that cross into the next row are the caller's to leave out."""
    size = max(0, len(words) - n + 1)
    h = words[:size].copy()
    for k in range(1, n):
        h = h * np.uint64(_BASE) + words[k:size + k]
    return mix(h)
