"""Hashes of words and of word windows for whole Arrow batches, computed with NumPy.

A batch's texts lie end to end in one buffer. Words are found as runs of bytes outside a separator table, and a
word's hash is a polynomial over its bytes (each byte stands for a random 64-bit number), taken as a difference
of prefix sums. No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators and codes for loose matching: ASCII letters in either case are one, other ASCII but digits separates.
LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOOSE_CODES = _CODES[[ord(chr(b).lower()) if b < 128 else b for b in range(256)]]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        _powers[str(base)] = np.multiply.accumulate(have, out=have)
    return _powers[str(base)][:n]


@dataclass
class Words:
    """The words of some texts in order. doc: the number of a word's text; first: each text's first word, and the end."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every run of n words inside one text."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        size = len(self.hash) - n + 1
        out = self.hash[:size].copy()
        for k in range(1, n):
            out *= _U(_BASE)
            out += self.hash[k : k + size]
        at = np.flatnonzero(self.doc[:size] == self.doc[n - 1 :])
        return mix(out[at]), at


def _hashed(data: np.ndarray, ends: np.ndarray, separators: np.ndarray, codes: np.ndarray) -> Words:
    docs, n = len(ends) - 1, len(data)
    if not n:
        return Words(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(docs + 1, np.int64))
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * _power(_BASE, n), out=sums[1:])
    values = mix((sums[stop] - sums[start]) * _power(_INVERSE, n)[start])
    first = np.searchsorted(start, ends)
    return Words(values, np.repeat(np.arange(docs), np.diff(first)), first)


def slices(column: pa.Array, at_most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, ends of the texts) of runs of texts with about so many bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    k = 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + at_most, "right")) - 1)
        yield k, data[ends[k] : ends[to]], ends[k : to + 1] - ends[k]
        k = to


def word_hashes(column: pa.Array, loose: bool = False, at_most: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """(number of the first text, its words and those of the next ones) over a whole column of texts."""
    for k, data, ends in slices(column, at_most):
        yield k, _hashed(data, ends, *((LOOSE, LOOSE_CODES) if loose else (SPACES, _CODES)))


def hash_text(text: str, loose: bool = False) -> np.ndarray:
    """The word hashes of one text."""
    return next(word_hashes(pa.array([text]), loose))[1].hash
