"""Vectorised scanning of Arrow text columns: words, word hashes and n-gram hashes without a Python object a word.

Texts are processed in blocks of about ``BLOCK_BYTES`` (a longer text is a block of its own), so memory follows
the block, not the Arrow batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: two rounds of shift and multiply."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, from its number.
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64, kept between calls."""
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 256) - 1, np.uint64(0xD6E8FEB86659FD93))]))
    return _powers[:n]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: Bytes of words, for UTF-8 text in which every byte of 128 and above belongs to a word.
BLANK_SEPARATED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
ALPHANUMERIC = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is an empty text."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text each, and one row at least."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


class Words:
    """The words of a block: ``start`` and ``end`` byte, ``doc`` (row of the block), ``first`` (each row's first word)."""

    def __init__(self, column: pa.Array, is_word: np.ndarray):
        data, at = utf8(column)
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True  # no word crosses from one text into the next
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.data, self.at, self._inside = data, at, inside
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, at)
        self.n_docs = len(at) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        begin = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        value = _BYTE[LOWER[self.data[self._inside]]] * powers(int(length.max()))[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * _STEP)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """A 64-bit hash of the first ``n`` code points of each word with A-Z lower-cased; 0 for words that are shorter."""
        lead = (self.data & 0xC0) != 0x80
        begin = np.append(np.flatnonzero(lead), len(self.data))
        place = np.concatenate([[0], np.cumsum(lead)])[self.start] + n
        stop = begin[np.minimum(place, len(begin) - 1)]
        long = np.flatnonzero((place < len(begin)) & (stop <= self.end))
        out, total = np.zeros(len(self.start), np.uint64), np.full(len(long), n, np.uint64) * _STEP
        live, k = np.arange(len(long)), 0
        while len(live):  # at most the bytes of n code points
            total[live] += _BYTE[LOWER[self.data[self.start[long[live]] + k]]] * powers(k + 1)[k]
            k += 1
            live = live[self.start[long[live]] + k < stop[long[live]]]
        out[long] = mix(total + np.uint64(1))
        return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive word hashes; empty if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i, p in enumerate(powers(n + 1)[1:]):
        total += words[i : len(words) - n + 1 + i] * p
    return mix(total)
