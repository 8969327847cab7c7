"""Words and their hashes for a whole Arrow batch at once, in numpy.

Works on the UTF-8 bytes of the batch's string buffer, in slices of bounded size, so memory follows the slice (or
its one longest text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES, PART_ROWS = 1 << 19, 1000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_ROLL = _U(0xD6E8FEB86659FD93)

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_powers = np.ones(1, np.uint64)
_roll_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(2 * n, _BASE, np.uint64))
    return _powers


def _rolls(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd factor of rolling hashes, and of its inverse modulo 2^64: n of each at least."""
    global _roll_powers
    if len(_roll_powers[0]) < n:
        _roll_powers = tuple(np.cumprod(np.concatenate(([_U(1)], np.full(2 * n, x, np.uint64)))) for x in (_ROLL, _U(pow(int(_ROLL), -1, 1 << 64))))
    return _roll_powers


@dataclass
class Words:
    """The words of some texts. Places are in bytes of `data`."""

    first: int  # number of the first text in the batch
    data: np.ndarray  # uint8, the texts one after another
    bounds: np.ndarray  # int64, where texts begin, and the end
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # text of each word, from 0
    hash: np.ndarray  # uint64

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        upto = np.concatenate(([0], np.cumsum(_STARTS_CHAR[self.data])))
        return upto[self.end] - upto[self.start]


def as_strings(column: pa.ChunkedArray | pa.Array) -> pa.LargeStringArray:
    """One array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded length, none empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def slices(texts: pa.LargeStringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds) of runs of texts of about `most` bytes; a longer text is a run by itself."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(texts: pa.LargeStringArray, lower: bool, most: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of each run of texts; lower: A-Z are hashed as a-z."""
    for first, data, bounds in slices(texts, most):
        inside = _IS_WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = bounds[(bounds > 0) & (bounds < len(data))]  # texts touch in the buffer
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size = end - start
        power = _power(int(size.max()) if len(size) else 1)
        held = data[inside]
        held = _LOWER[held] if lower else held
        at = np.arange(len(held)) - np.repeat(np.cumsum(size) - size, size)
        terms = (held.astype(np.uint64) + _U(1)) * power[at]
        total = np.add.reduceat(terms, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
        doc = np.searchsorted(bounds, start, "right") - 1
        yield Words(first, data, bounds, start, end, doc, mix(total ^ (size.astype(np.uint64) * _ROLL)))


def rolling(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums of the hashes weighed by rising powers: any run's hash is a difference of two, brought to power 0."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _rolls(len(hashes))[0][: len(hashes)], out=total[1:])
    return total


def run_hashes(prefix: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hash of the run of n words from each start, by the rolling prefix; the same wherever the run is."""
    return mix((prefix[start + n] - prefix[start]) * _rolls(len(prefix))[1][start])


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of n words, which of them lie in one text); empty where there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return run_hashes(rolling(hashes), np.arange(m), n), doc[:m] == doc[n - 1 :]
