"""Words of many texts at once, found on their bytes.

A batch's texts are laid end to end, a break between them, and every byte is one of three kinds: of a word, a gap between two
words, or a break that no phrase goes across.  Bytes of characters beyond ASCII are above 0x7F, so what is said of ASCII characters
can be told from single bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, GAP, BREAK = 0, 1, 2
#: Bytes of text that are taken at a time; a longer text is taken alone, whole.
BATCH_BYTES = 4 << 20


def kinds(gaps: bytes = b"", breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte: letters but for those named.  The break between texts is a line feed, which has to be no letter."""
    table = np.full(256, LETTER, np.uint8)
    table[np.frombuffer(gaps, np.uint8)] = GAP
    table[np.frombuffer(breaks, np.uint8)] = BREAK
    if table[10] == LETTER:
        raise ValueError("a line feed has to be a gap or a break")
    return table


@dataclass
class Words:
    """``text`` is the text's number for each word, ``piece`` a number that changes at breaks, ``words`` the words as bytes."""

    text: np.ndarray
    piece: np.ndarray
    words: pa.Array

    def __len__(self) -> int:
        return len(self.text)


def words_of(texts: list[bytes | None], table: np.ndarray) -> Words:
    """All words of the texts in order, A-Z lower-cased; a null has none."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(t or b"" for t in texts).lower(), np.uint8)
    kind = table[data]
    letters = kind == LETTER
    none = np.zeros(1, np.int8)
    edges = np.flatnonzero(np.diff(letters.view(np.int8), prepend=none, append=none))
    starts, ends = edges[0::2], edges[1::2]
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))  # where each text begins
    text = np.searchsorted(first, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    # A single text of over 2 GB can't come out of Spark, so 32 bits hold the places in a batch.
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[letters].tobytes())])
    return Words(text, piece, found)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts have so many bytes together, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
