"""Byte-level BPE as a lazily determinised finite-state transducer, with a streaming decoder.

The merges of a rank file define one token sequence for every piece of text.  A sequence is that one exactly when each
adjacent pair of its tokens is what the merges make of the pair's own bytes (Berglund and van der Merwe, "Formalizing BPE
tokenization").  So the tokens that end at a byte depend on a bounded window: the longest suffix that some token may still
continue, and the tokens that end in that window.  These are the transducer's states.  They are made when a text first needs
them, each with its outgoing byte transitions; a token is emitted when every position that may still be continued descends from it.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read_table

#: Pieces at least this long are not remembered whole; the transducer reads them byte by byte each time.
MEMO_PIECE = 64
#: The memo starts anew at its size and keeps the one before as well; the tables of states, plans and known pairs are emptied at
#: theirs, so a worker's memory is bounded.
MEMO_ROWS, MAX_STATES, MAX_PLANS, MAX_PAIRS = 100_000, 120_000, 100_000, 200_000
#: The rank of a pair that no merge joins.
NEVER = 1 << 60
#: Texts are split into pieces in one go up to this many characters, beyond it piece by piece.
WHOLE_TEXT = 1_000_000
#: Bits of a token id within a transition; ids beyond them are refused.
ID_BITS = 20
#: Rows of an Arrow batch that are worked on at a time.
SLICE = 1000
#: Tokens joined at a time by the decoder.
DECODE_CHUNK = 8192


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Bytes of one piece in, token ids out.

    A state holds the bytes that a token may still continue and, for each position where such a token can begin, the token
    that ends there.  A step reads a byte and says which token ends after it.  Tokens are emitted once every position that
    is still open descends from them, after no more bytes than the longest token has.

    What a byte does to the bytes alone is a *plan*: the tokens that may end, and the positions that stay open.  Windows are
    few, so a new state costs a look at its plan and at the pairs of tokens that the plan names.
    """

    def __init__(self, ranks: dict[bytes, int], tables: float = 1):
        if any(not 0 <= i < 1 << ID_BITS for i in ranks.values()):
            raise ValueError(f"token ids have to be from 0 to {(1 << ID_BITS) - 1}")
        self.ranks = ranks
        self.max_states, self.max_plans, self.max_pairs = (int(tables * most) for most in (MAX_STATES, MAX_PLANS, MAX_PAIRS))
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length_of = {i: len(t) for t, i in ranks.items()}
        self.lookahead = max(map(len, ranks), default=1)
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self.windows: list[tuple[bytes, tuple[int, ...]]] = []
        self.window_of: dict[bytes, int] = {}
        self.plans: dict[int, tuple[list, list, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[bool, list, list]] = {}
        self._reset()

    def _reset(self) -> None:
        start = (self._window(b""), -1)
        self.states, self.index = [start], {start: 0}
        self.step: dict[int, int] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        return [self.ranks[p] for p in self._merged(piece)[0]]

    def _merged(self, piece: bytes) -> tuple[list[bytes], list, list]:
        """The merged parts, and what stood at the left and the right end until which merge took it in."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank_of = self.ranks.get
        ranks = [rank_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        left, right = [], []
        while ranks and (rank := min(ranks)) != NEVER:
            at = ranks.index(rank)
            if at == 0:
                left.append((parts[0], rank))
            if at == len(ranks) - 1:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], NEVER)
        return parts, [*left, (parts[0], NEVER)] if parts else [], [*right, (parts[-1], NEVER)] if parts else []

    def _edge(self, token: int) -> tuple[bool, list, list]:
        if (known := self.edges.get(token)) is None:
            parts, left, right = self._merged(self.bytes_of[token])
            known = self.edges[token] = (len(parts) == 1, left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they stand together; left -1: at the start.

        They do unless, at some time while both tokens are built up, a merge across the seam outranks the next merges of
        the two parts that touch it.
        """
        if len(self.pairs) > self.max_pairs:
            self.pairs.clear()
        whole, ahead, _ = self._edge(right)
        if left < 0:
            known = whole
        else:
            left_whole, _, behind = self._edge(left)
            known = whole and left_whole and self._seam_holds(behind, ahead)
        self.pairs[left + 1 << ID_BITS | right] = known
        return known

    def _seam_holds(self, behind: list, ahead: list) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = behind[i], ahead[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < x_until and rank <= y_until and rank != NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _window(self, window: bytes) -> int:
        """The number of a window, beside which stand the positions where a token can have begun that goes on, and its end."""
        if (known := self.window_of.get(window)) is None:
            known = self.window_of[window] = len(self.windows)
            self.windows.append((window, (*(k for k in range(len(window)) if window[k:] in self.open), len(window))))
        return known

    def _plan(self, number: int, byte: int) -> tuple[list, list, int]:
        """Of a window and a byte: the tokens that may end, longest first, and the open positions that stay so, both by the place
        in a state where the position's token stands; then the next window."""
        if len(self.plans) > self.max_plans:
            self.plans.clear()
        window, at = self.windows[number]
        seen = window + bytes((byte,))
        ending = [(place, token) for place, k in enumerate(at, 1) if (token := self.ranks.get(seen[k:])) is not None]
        first = next((k for k in at if seen[k:] in self.open), len(seen))
        to = self._window(seen[first:])
        still = {k + first for k in self.windows[to][1]}
        known = self.plans[number << 8 | byte] = (ending, [place for place, k in enumerate(at, 1) if k in still], to)
        return known

    def _determinise(self, number: int, byte: int) -> int:
        state = self.states[number]
        ending, staying, to = self.plans.get(state[0] << 8 | byte) or self._plan(state[0], byte)
        for place, token in ending:
            fits = self.pairs.get(state[place] + 1 << ID_BITS | token)
            if self._fits(state[place], token) if fits is None else fits:
                break
        else:
            raise ValueError("the ranks don't give each single byte a token")
        target = (to, *[state[place] for place in staying], token)
        if (next_number := self.index.get(target)) is None:
            next_number = self.index[target] = len(self.states)
            self.states.append(target)
        self.step[number << 8 | byte] = found = next_number << ID_BITS | token
        return found

    def _settled(self, labels: list[int], upto: int) -> list[int]:
        """The tokens that lead to position ``upto``, read off backwards."""
        out, length = [], self.length_of
        while upto > 0:
            out.append(token := labels[upto - 1])
            upto -= length[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:  # the rank files' rule: a piece that is a token stays whole
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        labels: list[int] = []
        state, known, token_of = 0, self.step.get, (1 << ID_BITS) - 1
        for at in range(0, len(piece), self.lookahead):
            for byte in piece[at : at + self.lookahead]:
                found = known(state << 8 | byte) or self._determinise(state, byte)  # no step leads to the start, state 0
                state = found >> ID_BITS
                labels.append(found & token_of)
            if len(piece) > at + self.lookahead:
                self._emit(labels, state, out)
        return out + self._settled(labels, len(labels))

    def _emit(self, labels: list[int], state: int, out: list[int]) -> None:
        """Emit what every open position agrees on, and forget its labels."""
        window, at = self.windows[self.states[state][0]]
        paths = [self._settled(labels, len(labels) - len(window) + k) for k in at]
        agreed = 0
        while all(len(p) > agreed for p in paths) and len({p[agreed] for p in paths}) == 1:
            agreed += 1
        out += paths[0][:agreed]
        del labels[: sum(self.length_of[t] for t in paths[0][:agreed])]


class Utf8Stream:
    """Bytes in, whole characters out; the head of a character that is cut off waits for its rest."""

    def __init__(self) -> None:
        self.kept = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte & 0xC0 == 0x80:  # a continuation: its lead stands before
                continue
            length = 1 if byte < 0x80 else 2 if byte >> 5 == 0b110 else 3 if byte >> 4 == 0b1110 else 4 if byte >> 3 == 0b11110 else 1
            return back if length > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.kept + data
        cut = len(data) - self._open_tail(data)
        self.kept = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.kept = self.kept, b""
        return rest.decode("utf-8", "replace")


def _latin_classes(pattern: str) -> re.Pattern:
    """``pattern`` for texts of characters below U+0250, its classes spelt out: the standard library's engine is faster."""

    def chars(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)

    space = r"\t-\r \u0085\u00a0"
    letters, numbers = chars("L"), chars("N")
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(spelt.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


_BEYOND_LATIN = re.compile("[^\\x00-\u024f]")


class Encoder:
    """A task's transducer and what it remembers; both end with the task, since the Python worker that ran it serves other operators.

    ``tables`` is the share of the bounds of both that they may have: less memory for more time, and the same ids.
    """

    def __init__(self, ranks: bytes, pattern: str, tables: float = 1):
        self.fst = Transducer(parse_ranks(ranks), tables)
        self.memo_rows = int(tables * MEMO_ROWS)
        self.split, self.split_latin = regex.compile(pattern), _latin_classes(pattern)
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _miss(self, piece: str) -> bytes:
        if (packed := self.before.get(piece)) is None:
            packed = array("i", self.fst.encode(piece.encode())).tobytes()
        if len(piece) < MEMO_PIECE:
            if len(self.memo) >= self.memo_rows:
                self.before = dict(self.memo)
                self.memo.clear()  # whoever looks up in it goes on
            self.memo[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        split = self.split if _BEYOND_LATIN.search(text) else self.split_latin
        pieces: Iterable[str] = split.findall(text) if len(text) <= WHOLE_TEXT else (m[0] for m in split.finditer(text))
        known, miss = self.memo.get, self._miss
        return b"".join([known(p) or miss(p) for p in pieces])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def encode_texts(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    packed = [encoder.encode(t) if t else b"" for t in (x.as_py() for x in texts)]
    ends = pa.array([0, *_running(len(p) // 4 for p in packed)], pa.int32())
    values = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(ends, values)


def token_table(known: dict[int, bytes]) -> list[bytes]:
    return [known.get(i, b"") for i in range(max(known, default=-1) + 1)]


def decode_ids(tokens: list[bytes], lists: pa.ListArray) -> pa.Array:
    token, texts = tokens.__getitem__, []
    for ids in (x.values for x in lists):
        ids, stream, out = ids.to_numpy().tolist() if ids is not None else [], Utf8Stream(), []
        for at in range(0, len(ids), DECODE_CHUNK):
            out.append(stream.feed(b"".join(map(token, ids[at : at + DECODE_CHUNK]))))
        texts.append("".join([*out, stream.close()]))
    return pa.array(texts, pa.string())


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``, a row for each row of ``docs``.

    A null or empty text has no ids; a null id stays null; repeated rows stay repeated; other columns are left out, so
    their names can't clash.  An empty table gives an empty one.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in slices(rows):
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_texts(encoder, batch.column(1))], ["doc_id", "ids"])
        del encoder
        give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(batches, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``(doc_id, ids, text)`` from ``encode``'s rows; ids that end in the middle of a character give U+FFFD there."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table({i: t for t, i in parse_ranks(ranks).items()})
        for batch in slices(rows):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decode_ids(tokens, batch.column(1))], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, "doc_id long, ids array<int>, text string")


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", tables: float = 1) -> DataFrame:
    """``decode(encode(docs))`` in one Python worker for each task, with one copy of the vocabulary."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern, tables)
        tokens = token_table(encoder.fst.bytes_of)  # the same objects
        for batch in slices(rows):
            ids = encode_texts(encoder, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decode_ids(tokens, ids)], ["doc_id", "ids", "text"])
        del encoder, tokens
        give_back()

    return id_and_text(docs, id_col, text_col).mapInArrow(batches, "doc_id long, ids array<int>, text string")


def _running(sizes: Iterable[int]) -> Iterator[int]:
    total = 0
    for size in sizes:
        total += size
        yield total


def digest_columns() -> list[Column]:
    return [
        F.col("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    ]


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, tables: float = 1) -> DataFrame:
    """The contract's columns, a row for each row; null counts as empty.

    Texts of any length are encoded whole, in time that grows with it, and a row's ids are in memory once; null ids and repeated rows
    are rows like any others, an empty table gives an empty one, and other columns are left out, so their names can't clash.
    """
    ranks, pattern = public_vocabulary()
    return encode_decode(docs, ranks, pattern, tables=tables).select(*digest_columns())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
