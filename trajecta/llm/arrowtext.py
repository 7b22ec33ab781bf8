"""Bulk word splitting and hashing of Arrow string columns.

A block of texts is handled as one byte array, so that the cost of a word is a few NumPy operations.
All byte classes are ASCII, which never occurs inside a multi-byte UTF-8 sequence, so byte work is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are joined into blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: A-Z to a-z, all other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes of words that end at space, \t, \n, \v, \f or \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for runs of texts of about `size` bytes."""
    raw, at = buffers(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


@dataclass
class Words:
    """Words of one block: text index, byte range and 64-bit hash of each, in order of occurrence."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each 64-bit value."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        step = np.full(size, _MULTIPLIER, dtype=np.uint64)
        step[0] = 1
        _powers = np.cumprod(step)
        step[1:] = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        _inverses = np.cumprod(step)
    return _powers, _inverses


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    powers, inverses = _tables(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * powers[: len(data)], out=sums[1:])
    value = (sums[end] - sums[start]) * inverses[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of `flat` put one after the other."""
    before = np.cumsum(size) - size
    return flat[np.arange(int(size.sum())) + np.repeat(start - before, size)]


def strings(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow column of text."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(gathered(flat, start, size))))


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray = SPACED, fold: np.ndarray | None = FOLD) -> Words:
    """Maximal runs of bytes of the class `inside`, within each text, with hashes of their folded bytes."""
    n_texts = len(at) - 1
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), n_texts)
    data = raw if fold is None else fold[raw]
    is_word = inside[data]
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    cuts = at[1:-1][at[1:-1] < len(raw)]
    before[cuts] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    value = hashes(data, start, end)
    text = np.repeat(np.arange(n_texts), np.diff(np.searchsorted(start, at)))
    return Words(text, start, end, value, n_texts)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word index, text, hash) of every run of `size` consecutive words of one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    value = w.hash[:n].copy()
    for k in range(1, size):
        value = mix(value * np.uint64(0xFF51AFD7ED558CCD) + w.hash[k : k + n])
    same = w.text[:n] == w.text[size - 1 :]
    first = np.flatnonzero(same)
    return first, w.text[first], value[first]
