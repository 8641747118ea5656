"""Conversations as training windows of a token budget, with a mask of what the loss counts.

A conversation's turns are read in order and cut into blocks of ``BLOCK_TURNS`` turn numbers, so that no conversation is one task's,
however long; no window goes across two blocks.  In a block, prefix sums of the turns' tokens tell where a window ends: at the last
turn whose prefix is within the window's budget, found by a binary search.  Every window begins with the conversation's system turn,
whose tokens are taken off the budget, and repeats the turns before it as far as ``history`` tokens go, though none in a block's first
window.  What a window repeats is context: the loss mask has every assistant turn once, in the window where it is new.

A turn that has more tokens than a window's budget is a window with nothing else new and over the budget; no text is ever cut.

In the text a turn is ``<turn role>``, a line feed, its text, ``</turn>`` and a line feed.  In turns' texts a backslash is put behind
the ``<`` of whatever could be read as one of these marks, with or without backslashes already there, so taking one away from each
such place gives the text back.  In roles ``%`` and line feeds are written as ``%25`` and ``%0A``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import Encoder, public_vocabulary
from .common import cut, give_back, read_table

#: Tokens of a window, and of the turns that it repeats, at most.
BUDGET, HISTORY = 1024, 256
#: Turn numbers of a block are equal but for the lowest bits; of one number a block has at most so many rows.
BLOCK_BITS = 12
BLOCK_TURNS = 1 << BLOCK_BITS
SYSTEM, TARGET = "system", "assistant"
#: Characters of windows that a task passes on at a time.
WRITTEN = 4 << 20

_MARK, _ESCAPED = re.compile(r"<(\\*/?turn)"), re.compile(r"<\\(\\*/?turn)")
_TURN = re.compile(r"<turn ([^\n]*)>\n(.*?)</turn>\n", re.DOTALL)

WINDOWS = "conv_id long, block long, part int, window int, text string, loss array<struct<start:long,end:long>>, n_turns int, n_repeated int, n_tokens long"

Counter = Callable[[], Callable[[str], int]]


def escaped(text: str) -> str:
    return _MARK.sub(r"<\\\1", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def opening(role: str) -> str:
    return f"<turn {role.replace('%', '%25').replace('\n', '%0A')}>\n"


CLOSING = "</turn>\n"


def turns_of(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of each turn of a window's text, and where its text begins and ends there."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield m[1].replace("%0A", "\n").replace("%25", "%"), unescaped(m[2]), m.start(2), m.end(2)
        at = m.end()


def tokens_counter(ranks: bytes, pattern: str) -> Counter:
    """Counts byte-level BPE tokens; made anew in each task."""

    def make() -> Callable[[str], int]:
        encoder = Encoder(ranks, pattern)
        return lambda text: len(encoder.encode(text)) // 4

    return make


@dataclass
class Block:
    """Turns of one conversation in order, written out: opening, text, closing."""

    conv: int | None
    number: int | None
    part: int = 0
    lead: tuple[str, str] | None = None  # the system turn if it stands in an earlier block
    is_first: bool = True  # of its conversation
    written: list[tuple[str, str]] = field(default_factory=list)
    target: list[bool] = field(default_factory=list)
    own_lead: bool = False  # the first of the turns is the system turn

    @property
    def system(self) -> tuple[str, str] | None:
        return self.written[0] if self.own_lead else self.lead

    def windows(self, count: Callable[[str], int], budget: int, history: int) -> Iterator[tuple]:
        tokens = np.array([count(a + b + CLOSING) for a, b in self.written], np.int64)
        before = np.concatenate(([0], np.cumsum(tokens)))
        lead = self.system
        lead_tokens = count(lead[0] + lead[1] + CLOSING) if lead else 0
        first_own = int(self.own_lead)  # history never repeats the system turn, which is there anyway
        start, window = 0, 0
        while start < len(tokens):
            is_there = self.own_lead and start == 0  # the first window has the system turn as one of its own
            past = start if start <= first_own else max(first_own, int(np.searchsorted(before, before[start] - history)))
            repeated = int(before[start] - before[past])
            room = budget - repeated - (0 if is_there else lead_tokens)
            end = max(start + 1, int(np.searchsorted(before, before[start] + room, "right")) - 1)
            if end == start + 1 and tokens[start] > room and past < start:  # the turn alone leaves no room for history
                past, repeated = start, 0
                end = max(start + 1, int(np.searchsorted(before, before[start] + budget - (0 if is_there else lead_tokens), "right")) - 1)
            shown = ([] if is_there or lead is None else [(lead, False)]) + [(self.written[i], i >= start and self.target[i]) for i in range(past, end)]
            text, loss, at = [], [], 0
            for (a, b), counts in shown:
                text += [a, b, CLOSING]
                if counts:
                    loss.append({"start": at + len(a), "end": at + len(a) + len(b)})
                at += len(a) + len(b) + len(CLOSING)
            total = repeated + int(before[end] - before[start]) + (0 if is_there else lead_tokens)
            yield self.conv, self.number, self.part, window, "".join(text), loss, len(shown), len(shown) - (end - start), total
            start, window = end, window + 1


def blocked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, block, lead, turn, role, text)``: the turns, and before those of a conversation's later blocks a row with ``lead``.

    That row is the conversation's system turn, its first if it is one; else its role is null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = rows.select("conv_id", F.shiftright("turn", BLOCK_BITS).alias("block"), F.lit(False).alias("lead"), "turn", "role", "text")
    blocks = rows.select("conv_id", "block").distinct()
    first = F.min(F.struct(F.col("block").isNull(), "block"))  # null turns come last
    several = cut(blocks.groupBy("conv_id").agg(first["block"].alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "chat-several")
    if several.isEmpty():
        return rows
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    heads = rows.groupBy("conv_id").agg(F.min(F.struct(F.col("turn").isNull(), "turn", "role", "text")).alias("head"))
    known = several.join(heads.withColumnRenamed("conv_id", "_conv"), same("conv_id", "_conv")).drop("conv_id")
    later = blocks.join(known, same("conv_id", "_conv")).filter(~same("block", "first"))
    is_system = F.col("head.role") == SYSTEM
    leads = later.select("conv_id", "block", F.lit(True).alias("lead"), F.col("head.turn").alias("turn"), F.when(is_system, F.col("head.role")).alias("role"), F.when(is_system, F.col("head.text")).alias("text"))
    return rows.unionByName(leads)


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", F.col("lead").desc(), F.col("turn").asc_nulls_last(), "role", "text"
    )


def windows(
    turns: DataFrame,
    count: Counter,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv_id, block, part, window, text, loss, n_turns, n_repeated, n_tokens)``: the windows of all conversations.

    ``loss`` are spans of code points in ``text``, each of the whole text of an assistant turn; the first ``n_repeated`` of the
    window's ``n_turns`` turns stand in an earlier window as well.  Turns go by their number, null last, then by role and text; rows
    that tie or repeat are turns each.  A null id is a conversation, a null text or role is empty, texts of any length stay whole, an
    empty table gives an empty one, and other columns are left out, so their names can't clash.
    """
    rows = blocked(turns, conv_col, turn_col, role_col, text_col)

    def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        now = None
        for batch in batches:
            for conv, number, lead, _, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                same = now is not None and (conv, number) == (now.conv, now.number)
                if not same or len(now.written) >= BLOCK_TURNS:
                    if now is not None:
                        yield now
                    now = Block(conv, number, now.part + 1, now.system, False) if same else Block(conv, number)
                if lead:
                    now.lead, now.is_first = None if role is None else (opening(role), escaped(text)), False
                else:
                    now.own_lead |= now.is_first and not now.written and role == SYSTEM
                    now.written.append((opening(role), escaped(text)))
                    now.target.append(role == TARGET)
        if now is not None:
            yield now

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done, size = count(), [], 0
        for block in blocks_in(rows):
            for row in block.windows(counts, budget, history):
                done.append(row)
                size += len(row[4])
                if size >= WRITTEN:
                    yield record(done)
                    done, size = [], 0
        yield record(done)
        give_back()

    return in_order(rows).mapInArrow(batches, WINDOWS)


def record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], [n for n, _ in _TYPES])


_TYPES = [
    ("conv_id", pa.int64()),
    ("block", pa.int64()),
    ("part", pa.int32()),
    ("window", pa.int32()),
    ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("n_turns", pa.int32()),
    ("n_repeated", pa.int32()),
    ("n_tokens", pa.int64()),
]

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Digest:
    """What is read back from a conversation's windows as they pass by; it holds no text."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.formatted = conv, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict], n_repeated: int) -> None:
        self.formatted += len(text)
        for i, (role, said, _, _) in enumerate(turns_of(text)):
            if i >= n_repeated:
                self.turns += 1
                self.whole.update(f"{role}\n{said}\n".encode())
        for span in loss:
            said = unescaped(text[span["start"] : span["end"]])
            self.chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.whole.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read from its windows alone.  SHA-256 takes a conversation's text in order, so one task reads it, as a stream."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in rows:
            for conv, text, loss, n_repeated in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "n_repeated")], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv)
                now.add(text, loss, n_repeated)
            if done:
                yield digest_rows(done)
                done = []
        if now is not None:
            yield digest_rows([now.row()])

    def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in DIGESTS.split(", ")]).cast(_DIGEST_TYPES)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").asc_nulls_last(), "part", "window")
    return ordered.mapInArrow(batches, DIGESTS)


_DIGEST_TYPES = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in DIGESTS.split(", "))])

#: A conversation whose texts are full of what could be taken for marks.
CONTROL = [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", TARGET))]


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    formatted = cut(windows(conversations.unionByName(control), tokens_counter(*public_vocabulary())), "chat-windows")
    return digests(formatted)
