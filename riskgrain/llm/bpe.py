"""BPE encoding and decoding: tree concatenation of independently encoded halves.

A text longer than a leaf is halved until its pieces fit, the pieces are encoded in
parallel threads, and neighbours are joined pairwise.  At a join a window of whole
tokens around the cut is encoded again and doubled until its first token equals the
left side's token there and its last token the right side's.  A sequence is the BPE
encoding exactly when every two neighbouring tokens are; agreement at both ends
therefore makes the joined sequence the encoding of the whole text.  A window starts
and ends only where splitting into pretokens does not depend on what lies outside:
between a visible character and white space, or between two letters.

Special tokens of the vocabulary are split off first, as their own ids.  Defined
cases: null counts as empty, an empty text has no ids, any text decodes to itself.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

LEAF_CHARS = 16_384
WINDOW_TOKENS = 16

#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file (JSON with ``model.vocab`` and ``added_tokens``)."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_tokens: int = WINDOW_TOKENS, threads: int = 2):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): rank for token, rank in content["model"]["vocab"].items()
            if token not in self.special}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.leaf_chars, self.window_tokens, self.threads = leaf_chars, window_tokens, threads

    def _sections(self, text: str):
        """Text between special tokens, and the ids of those."""
        while True:
            found = min(((at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0), default=None)
            if found is None:
                yield text, None
                return
            at, _, token = found
            yield text[:at], self.special[token]
            text = text[at + len(token):]

    def encode(self, text: str) -> list[int]:
        if "<" not in text or not any(s in text for s in self.special):
            return self._encode_section(text)
        ids: list[int] = []
        for section, special in self._sections(text):
            ids += self._encode_section(section)
            if special is not None:
                ids.append(special)
        return ids

    def _encode_section(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.bpe.encode_ordinary(text)
        pieces = [text]
        while len(pieces[0]) > self.leaf_chars:
            pieces = [half for p in pieces for half in (p[:(len(p) + 1) // 2], p[(len(p) + 1) // 2:])]
        with ThreadPoolExecutor(self.threads) as pool:
            parts = list(zip(pieces, pool.map(self.bpe.encode_ordinary, pieces)))
            while len(parts) > 1:
                parts = list(pool.map(self._join, parts[::2], parts[1::2]))
        return parts[0][1]

    def _lengths(self, ids: list[int]) -> np.ndarray:
        """Bytes before each token and after the last."""
        return np.concatenate([[0], np.cumsum([len(b) for b in self.bpe.decode_tokens_bytes(ids)])]).astype(np.int64)

    @staticmethod
    def _open(data: bytes, at: int) -> bool:
        """Whether the pretokens after byte ``at`` are the same with and without the text before it, and the other way round."""
        a, b = data[at - 1:at], data[at:at + 1]
        return a.isalpha() and b.isalpha() or a.isascii() and b.isascii() and not a.isspace() and b.isspace()

    def _join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        (text_a, ids_a), (text_b, ids_b) = left, right
        data_a, data_b = text_a.encode(), text_b.encode()
        lengths_a, lengths_b = self._lengths(ids_a), self._lengths(ids_b)
        width = self.window_tokens
        while True:
            first, last = max(0, len(ids_a) - width), min(len(ids_b), width)
            while first and not self._open(data_a, lengths_a[first]):
                first -= 1
            while last < len(ids_b) and not self._open(data_b, lengths_b[last]):
                last += 1
            window = data_a[lengths_a[first]:] + data_b[:lengths_b[last]]
            ids = self.bpe.encode_ordinary(window.decode())
            if (first == 0 or ids[0] == ids_a[first]) and (last == len(ids_b) or ids[-1] == ids_b[last - 1]):
                return text_a + text_b, ids_a[:first] + ids + ids_b[last:]
            width *= 2

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode("utf-8", "replace")


def _encode(path: str, options: dict):
    def run(batches):
        codec = Codec(path, **options)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names[:-1])}
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.record_batch({**columns, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))})
    return run


def _decode(path: str, options: dict):
    def run(batches):
        codec = Codec(path, **options)
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names[:-1])}
            texts = [codec.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch({**columns, "decoded": pa.array(texts, pa.string())})
    return run


def _round_trip(path: str, options: dict, keep_ids: bool):
    def run(batches):
        codec = Codec(path, **options)
        for batch in batches:
            counts, ids_sha, text_sha, lists = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                raw = np.array(ids, "<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                if keep_ids:
                    lists.append(raw.astype(np.int32))
            out = {
                "id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()),
                "decoded_sha256": pa.array(text_sha, pa.string())}
            yield pa.record_batch(out | ({"ids": pa.array(lists, pa.list_(pa.int32()))} if keep_ids else {}))
    return run


def _mapped(df: DataFrame, run, column: Column, name: str, kind: str) -> DataFrame:
    """All columns of ``df`` but those named like the result, and the result."""
    rest = df.drop(name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"{name} {kind}"])
    return df.select(*[F.col(f"`{c}`") for c in rest.columns], column).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", **options) -> DataFrame:
    """``docs`` with the token ids of ``text`` in a column ``ids``, which replaces one of that name."""
    return _mapped(docs, _encode(path, options), F.col(text).alias("_text"), "ids", "array<int>")


def decode(tokens: DataFrame, path: str, ids: str = "ids", **options) -> DataFrame:
    """``tokens`` with the text of ``ids`` in a column ``decoded``, which replaces one of that name."""
    return _mapped(tokens, _decode(path, options), F.col(ids).alias("_ids"), "decoded", "string")


def round_trip(
    docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", keep_ids: bool = False, **options,
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids])``: each text encoded and its ids decoded again, one row per row."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        _round_trip(path, options, keep_ids), schema).withColumnRenamed("id", id)
