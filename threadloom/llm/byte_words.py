"""Words of whole Arrow batches as numbers: the bytes of all texts of a run are split and told apart at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte is, in the tables that word_table() makes.
WORD, SPACE, BREAK = 0, 1, 2
#: Bytes of text that are split at once; a text that is longer is a run of its own.
RUN_BYTES = 8 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_table(space: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte whether it belongs to a word, parts words, or parts words and ends a piece. ASCII bytes only, so
    that characters of several bytes stay whole."""
    table = np.full(256, WORD, np.uint8)
    table[list(space)] = SPACE
    table[list(breaks)] = BREAK
    return table


@dataclass(frozen=True)
class Words:
    """All words of some texts in order, A-Z lower-cased. ids point into distinct; row is each word's text;
    opens is true for the first word of a piece, and so of a text."""

    distinct: pa.BinaryArray
    ids: np.ndarray
    row: np.ndarray
    opens: np.ndarray


def split_words(texts: pa.StringArray, table: np.ndarray) -> Words:
    """The words of all texts; null has none."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = table[data]
    inside = kind == WORD
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets[:-1]] = True
    follows = np.zeros(len(data), bool)
    follows[1:] = inside[:-1] & ~edge[1:-1]
    starts = np.flatnonzero(inside & ~follows)
    ended = np.ones(len(data), bool)
    ended[:-1] = ~(inside[1:] & ~edge[1:-1])
    ends = np.flatnonzero(inside & ended) + 1
    sizes = ends - starts
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
    opens = np.ones(len(starts), bool)
    opens[1:] = (np.diff(piece) > 0) | (np.diff(row) > 0)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(_LOWER[data[inside]])])
    coded = packed.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, opens)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 32-bit hash of each word, the same in every task."""
    from zlib import crc32

    return np.fromiter((crc32(w) for w in words.to_pylist()), np.uint64, len(words))


def text_runs(batches: Iterator[pa.RecordBatch], text: int, size: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of about size bytes of text, column number text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
