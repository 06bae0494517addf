"""Words of Arrow text columns as numpy arrays: places, 64-bit hashes and hashed word windows.

A whole run of rows is handled at once on its UTF-8 bytes, so no Python object is made per word. Hashes of 64 well
mixed bits stand for words; two different words of a corpus of 10^9 distinct ones share a hash with probability 3 %.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
U64 = np.uint64


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the place where each row starts (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own and stays whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def chunks_of(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches with the bytes and row starts of their texts."""
    for batch in batches:
        data, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in row_chunks(offsets, limit):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=U64) | U64(1)


class WordReader:
    """Finds and hashes words. ``separators``: byte values between words; ``lower``: A-Z count as a-z."""

    def __init__(self, lower: bool, separators: Iterable[int] = SPACES, seed: int = 20):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.value = odd_numbers(seed, 256)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.value[~self.is_word] = 0
        self.power = np.ones(1, U64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            self.power = np.full(max(n, 256), 0x9E3779B97F4A7C15, U64)
            self.power[0] = 1
            self.power = np.multiply.accumulate(self.power)
        return self.power

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the number of the first word of each row (one more than rows)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        word = self.is_word[data]
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.empty_like(word)
        after[-1], after[:-1] = False, word[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U64)
        first = starts[0]
        size = np.diff(starts, append=len(data))
        place = np.arange(first, len(data)) - np.repeat(starts, size)
        longest = int((ends - starts).max())
        np.minimum(place, longest, out=place)  # beyond a word's end there are separators, which count 0
        weighted = self.value[data[first:]] * self._powers(longest + 1)[place]
        return mix(np.add.reduceat(weighted, starts - first))


def windows(word_hash: np.ndarray, first: np.ndarray, size: int, seed: int = 5, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside rows, and where each row's windows start (one more than rows).

    ``first``: number of the first word of each row (one more than rows). With ``short``, a row of fewer words
    than ``size``, but of at least one, has one window: all its words.
    """
    factor = odd_numbers(seed, size)
    n = len(word_hash)
    words = np.diff(first)
    count = np.maximum(words - size + 1, 0)
    if short:
        count[(words > 0) & (words < size)] = 1
    starts = np.concatenate([[0], np.cumsum(count)])
    if not starts[-1]:
        return np.zeros(0, U64), starts
    padded = np.concatenate([word_hash, np.zeros(size - 1, U64)])
    total = np.zeros(n, U64)
    for j in range(size):
        total += padded[j : j + n] * factor[j]
    at = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], count)
    out = total[at]
    if short:
        for r in np.flatnonzero((words > 0) & (words < size)):
            k = words[r]
            out[starts[r]] = (word_hash[first[r] : first[r] + k] * factor[:k]).sum(dtype=U64) + U64(k)
    return mix(out), starts


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, starts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind or pa.int64()))
