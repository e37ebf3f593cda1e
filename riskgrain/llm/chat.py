"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Turns are taken in chunks of ``CHUNK`` turn numbers, each with the last turns of the
chunk before as possible history and with the conversation's system turn, so a conversation of any length is spread over
tasks.  Within a chunk prefix sums of turn tokens give the longest run of new turns that
fits the budget beside the system turn and the history; a turn that alone exceeds the budget
is a window of its own, whole.  History is at most ``history`` turns and ``history_share`` of the budget.
The loss mask covers each assistant text once, where it is new.

A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.
Inside texts and roles ``<``, any backslashes and ``|`` get one backslash more, so no
text can hold a control string; ``read_windows`` takes it out again.  Line feeds and
backslashes in roles are escaped too.

Defined cases: a null role or text is empty; turns are ordered by number (null first), role and
text, so ties and repeated rows keep a defined order and are all formatted; a null
conversation id is one conversation; the system turn is the first with that role.  A turn's tokens
are a quarter of its code points, rounded up, and four for its marks.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUDGET, CHUNK = 1024, 64
START, END = "<|im_start|>", "<|im_end|>\n"
_MARKS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _MARKS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokens(role: str, text: str) -> int:
    return (len(role) + len(text) + 3) // 4 + 4


def windows(system, before, turns, budget: int, history: int, history_share: float):
    """``(system turn or None, repeated turns, new turns)`` of each window; turns are ``(role, text)``."""
    cost = [tokens(*t) for t in [*before, *turns]]
    sums = [0]
    for c in cost:
        sums.append(sums[-1] + c)
    every, at = [*before, *turns], len(before)
    while at < len(every):
        own = every[at] == system
        fixed = 0 if system is None or own else tokens(*system)
        back = at
        while back > 0 and at - back < history and every[back - 1] != system and sums[at] - sums[back - 1] <= budget * history_share:
            back -= 1
        while back < at and fixed + sums[at + 1] - sums[back] > budget:
            back += 1
        stop = at + 1
        while stop < len(every) and fixed + sums[stop + 1] - sums[back] <= budget:
            stop += 1
        yield None if own or fixed == 0 else system, every[back:at], every[at:stop]
        at = stop


def render(system, repeated, new) -> tuple[str, int, list[int], list[int]]:
    """Text of a window, where its new turns begin, and the starts and ends of the loss mask."""
    parts, size, starts, ends, fresh = [], 0, [], [], 0
    old = ([system] if system else []) + list(repeated)
    for k, (role, text) in enumerate([*old, *new]):
        if k == len(old):
            fresh = size
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if k >= len(old) and role == "assistant":
            starts.append(size + len(head))
            ends.append(size + len(head) + len(body))
        parts += [head, body, END]
        size += len(head) + len(body) + len(END)
    return "".join(parts), fresh, starts, ends


def _format(budget: int, history: int, history_share: float):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = row["system"]
                system = (first["role"], first["text"]) if first else None
                before = [(t["role"], t["text"]) for t in row["turns"] if not t["new"]][-history:] if history else []
                turns = [(t["role"], t["text"]) for t in row["turns"] if t["new"]]
                for k, w in enumerate(windows(system, before, turns, budget, history, history_share)):
                    out.append((row["conv_id"], row["chunk"], k, *render(*w)))
            names = ["conv_id", "chunk", "window", "text", "fresh_from", "loss_starts", "loss_ends"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = zip(*out) if out else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    return run


WINDOWS = "conv_id long, chunk long, window int, text string, fresh_from int, loss_starts array<int>, loss_ends array<int>"


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET,
    history: int = 4, history_share: float = 0.25, chunk: int = CHUNK,
) -> DataFrame:
    """``(conv_id, chunk, window, text, fresh_from, loss_starts, loss_ends)``: one row per window; offsets in code points."""
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 60))))
    if history:
        # the last turns of a chunk are also history of the next
        tail = F.pmod("turn", F.lit(chunk)) >= chunk - history
        rows = rows.withColumn("to", F.explode(F.when(
            tail, F.array(F.struct("chunk", F.lit(True).alias("new")), F.struct((F.col("chunk") + 1).alias("chunk"), F.lit(False).alias("new"))),
        ).otherwise(F.array(F.struct("chunk", F.lit(True).alias("new"))))))
        rows = rows.select("conv_id", "turn", "role", "text", "to.chunk", "to.new")
    else:
        rows = rows.withColumn("new", F.lit(True))
    first = rows.where("role = 'system' AND new").groupBy("conv_id").agg(
        F.min(F.struct("turn", "role", "text")).alias("system")).withColumnRenamed("conv_id", "_conv")
    grouped = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text", "new"))).alias("turns"))
    return grouped.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").mapInArrow(
        _format(budget, history, history_share), WINDOWS)


def read_window(text: str, fresh_from: int, starts: list[int], ends: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
    """The new turns of a window and the texts under its loss mask, unescaped."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text[fresh_from:])]
    return turns, [unescape(text[a:b]) for a, b in zip(starts, ends)]


def _read(batches):
    for batch in batches:
        counts, turns, losses, sizes = [], [], [], []
        for row in batch.to_pylist():
            new, masked = read_window(row["text"], row["fresh_from"], row["loss_starts"], row["loss_ends"])
            counts.append(len(new))
            turns.append("".join(f"{role}\n{text}\n" for role, text in new))
            losses.append("".join(masked))
            sizes.append(len(row["text"]))
        yield pa.record_batch({
            **{c: batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "chunk", "window")},
            "n_turns": pa.array(counts, pa.int64()), "turns": pa.array(turns, pa.string()), "loss": pa.array(losses, pa.string()),
            "chars": pa.array(sizes, pa.int64())})


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from them."""
    parts = formatted.mapInArrow(
        _read, "conv_id long, chunk long, window int, n_turns long, turns string, loss string, chars long")
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "window", "turns", "loss")))
    return parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"),
        ordered.alias("parts"),
    ).select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), ""), 256).alias("turns_sha256"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["loss"])).alias("loss_chars"),
        F.sha2(F.array_join(F.transform("parts", lambda p: p["loss"]), ""), 256).alias("loss_sha256"), "formatted_chars", "n_windows")
