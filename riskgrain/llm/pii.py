"""PII: character-level bidirectional LSTM with CRF transitions, trained in NumPy from labelled spans.

Exact patterns find the base spans.  Those of a bounded sample of documents label
windows of text, on which the tagger is trained: character classes, two LSTM
directions, one emission per tag and a linear-chain CRF.  Part of the training
windows have their phone numbers' country code taken off, so that the tagger learns the shape
and not the plus sign.  All documents are then cut into overlapping windows, each tag taken from the
window where it lies most centrally, and the spans of the joined tags are reconciled with the base
spans: base spans stay, and tagged spans that touch none of them and hold what their kind needs are
added.  A span without a digit or an at sign is never accepted, so windows with neither are not decoded.

Defined cases: a null text is empty and has no spans; positions are code points, ends exclusive;
without any labelled span there is no tagger and base spans are all; rows are scored one by one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_WINDOWS = 3000
WINDOW, MARGIN = 96, 16
HIDDEN = 12
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_DIGIT = re.compile(r"[0-9]")


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind: str, s: str) -> bool:
    """What a match of a base pattern must hold to count."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:] if p.lstrip("0") else "0") <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d := digits_of(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(digits_of(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    return [
        (kind, m.start(), m.end()) for kind, pattern in PATTERNS.items() if _NEEDS[kind] in text
        for m in pattern.finditer(text) if holds(kind, m[0])]


def acceptable(kind: str, s: str) -> bool:
    """What a tagged span must hold to be added."""
    digits = digits_of(s)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", s) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9.]+", s) is not None and s.count(".") == 3 and all(s.split(".")) and holds("ip", s)
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[ .\-/]{0,2}[0-9])+", s) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"[(+]?[0-9][ ().0-9\-/]+[0-9]", s) is not None and 10 <= len(digits) <= 15 and len(re.findall(r"[ ().\-/]+", s)) >= 2


# ---- character classes

_ASCII = {**{c: 1 for c in "0123456789"}, **{c: 2 for c in "abcdef"}, **{c: 3 for c in "ghijklmnopqrstuvwxyz"},
          **{c: 4 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, " ": 5, "\t": 5, "\n": 6}
_SIGNS = "@.-+()_%:=/\"'#,"
CLASSES = 8 + len(_SIGNS)


def _class_table() -> np.ndarray:
    table = np.full(128, 7, np.int8)
    for c, k in _ASCII.items():
        table[ord(c)] = k
    for k, c in enumerate(_SIGNS):
        table[ord(c)] = 8 + k
    return table


def classes_of(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of each code point; all beyond ASCII are letters."""
    return np.where(codes < 128, table[np.minimum(codes, 127)], 3)


# ---- the tagger

TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind


def _allowed() -> np.ndarray:
    """Whether a tag may follow another: further characters only after their own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Parameters and passes; windows are rows of class numbers, of one length."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (r.normal(0, 0.3, (CLASSES, 4 * h))).astype(np.float32)
            self.p["h" + d] = (r.normal(0, 0.3, (h, 4 * h))).astype(np.float32)
            self.p["x" + d][:, h:2 * h] += 1  # remember at first
        self.p["o"] = r.normal(0, 0.3, (2 * h, TAGS)).astype(np.float32)
        self.p["c"] = np.zeros(TAGS, np.float32)
        self.p["t"] = np.zeros((TAGS, TAGS), np.float32)
        self.mask = np.where(_allowed(), 0, -1e4).astype(np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states along time (windows, steps, hidden); ``keep``: also what the backward pass needs."""
        n, steps = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for s in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p["x" + d][x[:, s]] + h @ self.p["h" + d]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            previous, before = c, h
            c = f * c + i * g
            u = np.tanh(c)
            h = o * u
            out[s] = h
            if keep:
                tape.append((s, i, f, o, g, previous, u, before))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(steps, windows, tags)"""
        states = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return states @ self.p["o"] + self.p["c"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of each window (windows, steps)."""
        e = self.emissions(x)
        move = self.p["t"] + self.mask
        start = np.where(_allowed()[0], 0, -1e4).astype(np.float32)
        score, back = e[0] + start, np.empty((len(e), x.shape[0], TAGS), np.int8)
        for s in range(1, len(e)):
            reach = score[:, :, None] + move[None]
            back[s] = reach.argmax(axis=1)
            score = reach.max(axis=1) + e[s]
        tags = np.empty(x.shape, np.int8)
        tags[:, -1] = score.argmax(axis=1)
        rows = np.arange(len(x))
        for s in range(len(e) - 1, 0, -1):
            tags[:, s - 1] = back[s, rows, tags[:, s]]
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags ``y`` per window, and its gradient."""
        n, steps = x.shape
        rows = np.arange(n)
        forward, tape_f = self._run(x, "f", True)
        backward, tape_b = self._run(x, "b", True)
        states = np.concatenate([forward, backward], axis=2)
        e = states @ self.p["o"] + self.p["c"]
        move = self.p["t"] + self.mask

        def lse(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + np.where(_allowed()[0], 0, -1e4)
        for s in range(1, steps):
            alpha[s] = lse(alpha[s - 1][:, :, None] + move, 1) + e[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = lse(move[None] + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        node = np.exp(alpha + beta - total[None, :, None])
        gold = e[np.arange(steps)[:, None], rows, y.T].sum(axis=0) + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps):
            edge = np.exp(alpha[s - 1][:, :, None] + move + (e[s] + beta[s])[:, None, :] - total[:, None, None])
            grad["t"] += edge.sum(axis=0)
        np.add.at(grad["t"], (y[:, :-1], y[:, 1:]), -1)
        node[np.arange(steps)[:, None], rows, y.T] -= 1
        grad["o"] = np.einsum("snh,snt->ht", states, node)
        grad["c"] = node.sum(axis=(0, 1))
        down = node @ self.p["o"].T
        for d, tape, side in (("f", tape_f, down[:, :, :HIDDEN]), ("b", tape_b, down[:, :, HIDDEN:])):
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for s, i, f, o, g, previous, u, before in reversed(tape):
                dh = dh + side[s]
                dc = dc + dh * o * (1 - u * u)
                dz = np.concatenate([
                    dc * g * i * (1 - i), dc * previous * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                grad["h" + d] += before.T @ dz
                np.add.at(grad["x" + d], x[:, s], dz)
                dh, dc = dz @ self.p["h" + d].T, dc * f
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over shuffled batches with a falling rate; the last epoch's mean loss."""
        order, step, loss = np.random.default_rng(seed), 0, 0.0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            rows, losses = order.permutation(len(x)), []
            for a in range(0, len(rows), batch):
                part, step = rows[a:a + batch], step + 1
                value, grad = self.gradient(x[part], y[part])
                losses.append(value)
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / max(size, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


# ---- training windows

def _labelled_windows(batches):
    """Windows around base spans and around other digits and at signs: ``(text, spans)``, spans as kind:start:end."""
    for batch in batches:
        texts, spans = [], []
        for text in batch.column(0).to_pylist():
            found = base_spans(text or "")
            taken = [m.start() for m in re.finditer(r"[0-9@]+", text or "")]
            places = [a for _, a, _ in found] + [a for a in taken[:: max(1, len(taken) // 4)] if not any(s <= a < e for _, s, e in found)]
            for place in places:
                shift = int.from_bytes(hashlib.blake2b(f"{place}{len(text)}".encode(), digest_size=2).digest(), "little")
                start = max(0, min(place - MARGIN - shift % (WINDOW // 2), len(text) - WINDOW))
                inside = [(k, a - start, e - start) for k, a, e in found if a >= start and e <= start + WINDOW]
                cut = any(a < start < e or a < start + WINDOW < e for _, a, e in found)
                if not cut:
                    texts.append(text[start:start + WINDOW])
                    spans.append(",".join(f"{k}:{a}:{e}" for k, a, e in sorted(inside, key=lambda x: x[1])))
        yield pa.record_batch({"text": pa.array(texts, pa.string()), "spans": pa.array(spans, pa.string())})


def _tags(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, np.ndarray]:
    tags = np.zeros(WINDOW, np.int64)
    for kind, a, e in spans:
        k = KINDS.index(kind)
        tags[a:e] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return text.ljust(WINDOW)[:WINDOW], tags


def _without_code(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with its first phone number's country code taken off."""
    for n, (kind, a, e) in enumerate(spans):
        m = re.match(r"\+[0-9]+[ -]", text[a:e]) if kind == "phone" else None
        if m:
            cut = m.end()
            moved = [(k, s - cut if s > a else s, t - cut if s >= a else t) for k, s, t in spans]
            moved[n] = (kind, a, e - cut)
            return text[:a] + text[a + cut:], moved
    return text, spans


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger from at most ``sample`` labelled windows of documents drawn by the hash of their id."""
    source = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(id).alias("id"), F.col(text).alias("text"))
    n = source.count()
    if not n:
        return None
    drawn = F.pmod(F.xxhash64("id", F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)
    rows = source.where(drawn < min(1.0, sample / n)).select("text").mapInArrow(_labelled_windows, "text string, spans string").orderBy(
        F.xxhash64("text", "spans"), "text").limit(sample).collect()
    if not any(r["spans"] for r in rows):
        return None
    table, xs, ys = _class_table(), [], []
    for n, r in enumerate(rows):
        spans = [(k, int(a), int(e)) for k, a, e in (s.split(":") for s in r["spans"].split(",") if s)]
        string = r["text"]
        if n % 3 == 0:
            string, spans = _without_code(string, spans)
        string, tags = _tags(string, spans)
        xs.append(classes_of(np.frombuffer(string.encode("utf-32-le"), np.uint32), table))
        ys.append(tags)
    tagger = Tagger()
    tagger.fit(np.array(xs, np.int64), np.array(ys))
    return tagger


# ---- whole texts

def _window_starts(size: int, codes: np.ndarray) -> list[int]:
    """Starts of the windows of a text that hold a digit or an at sign."""
    hot = np.flatnonzero((codes >= 48) & (codes < 58) | (codes == 64))
    if not len(hot):
        return []
    step = WINDOW - 2 * MARGIN
    last = max(0, -(-(size - WINDOW) // step))
    low = np.clip(-(-(hot - WINDOW + 1) // step), 0, last)
    high = np.clip(hot // step, 0, last)
    wanted = np.zeros(last + 2, np.int64)
    np.add.at(wanted, low, 1)
    np.add.at(wanted, high + 1, -1)
    return (np.flatnonzero(np.cumsum(wanted)[:last + 1]) * step).tolist()


def tagged_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a text's joined tags: runs of one kind; a first character opens a new one."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    opens = (tags > 0) & ((tags % 2 == 1) | (np.concatenate([[-1], kind[:-1]]) != kind))
    starts = np.flatnonzero(opens)
    out = []
    for a in starts.tolist():
        k, e = kind[a], a + 1
        while e < len(tags) and kind[e] == k and not opens[e]:
            e += 1
        out.append((KINDS[k], a, e))
    return out


def reconcile(text: str, base: list[tuple[str, int, int]], tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and the acceptable tagged ones that touch none of them, by kind, then start."""
    added = []
    for kind, a, e in tagged:
        while a < e and text[a] in " \n\t.,;:":
            a += 1
        while e > a and text[e - 1] in " \n\t.,;:":
            e -= 1
        if acceptable(kind, text[a:e]) and not any(a < t and s < e for _, s, t in base):
            added.append((kind, a, e))
    return sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined_tags(tagger: Tagger, codes: list[np.ndarray], table: np.ndarray) -> dict[int, np.ndarray]:
    """Tags of each text with windows to decode, each from the window in which it lies most centrally."""
    places = [(k, s) for k, c in enumerate(codes) for s in _window_starts(len(c), c)]
    joined: dict[int, np.ndarray] = {}
    for at in range(0, len(places), 512):
        part = places[at:at + 512]
        x = np.full((len(part), WINDOW), 5, np.int64)
        for row, (k, s) in enumerate(part):
            piece = classes_of(codes[k][s:s + WINDOW], table)
            x[row, :len(piece)] = piece
        tags = tagger.decode(x)
        for row, (k, s) in enumerate(part):
            size = len(codes[k])
            whole = joined.setdefault(k, np.zeros(size, np.int8))
            a = 0 if s == 0 else MARGIN
            b = WINDOW if s + WINDOW >= size else WINDOW - MARGIN
            b = min(b, size - s)
            whole[s + a:s + b] = tags[row, a:b]
    return joined


def _find(tagger: Tagger | None):
    def run(batches):
        table = _class_table()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            joined = {}
            if tagger is not None:
                codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
                joined = _joined_tags(tagger, codes, table)
            out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone")}
            digests, spans = [], []
            for k, text in enumerate(texts):
                base = base_spans(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                shown = ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in base)
                digests.append(hashlib.sha256(shown.encode()).hexdigest())
                more = tagged_spans(joined[k]) if k in joined else []
                spans.append(",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in reconcile(text, base, more)))
            yield pa.record_batch({
                "id": batch.column(0), **{c: pa.array(v, pa.int64()) for c, v in out.items()},
                "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})
    return run


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE_WINDOWS) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: counts and digest of base spans, and all spans."""
    tagger = train(docs, id, text, sample)
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        _find(tagger), "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    ).withColumnRenamed("id", id)
