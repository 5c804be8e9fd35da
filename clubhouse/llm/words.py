"""Words and word hashes of many texts at once, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, as in the pattern ``[^\\x20\\x09-\\x0D]+``. All
functions work on Arrow string arrays inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a task.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))


def _odd(n: int) -> np.ndarray:
    return _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _odd(256)
_BYTE[_IS_SPACE] = 0
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = int(_odd(1)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _odd(64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    for i, base in enumerate((_BASE, _BASE_INVERSE)):
        while len(_powers[i]) < n:
            have = _powers[i]
            step = np.uint64(pow(base, len(have), 1 << 64))
            _powers[i] = np.concatenate([have, have * step])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a common public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts (nulls as empty) in runs of about SLICE_BYTES, in order.

    A text longer than that is a run of its own: texts are never cut.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 places where texts begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: ``starts`` and ``ends`` are byte places in
    ``data``, ``first[i]`` to ``first[i + 1]`` are the words of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        self.data, self.bounds = buffer_of(texts)
        data, bounds = self.data, self.bounds
        space = np.ones(len(data) + 2, bool)
        np.take(_IS_SPACE, data, out=space[1:-1])
        inside = ~space
        begins = inside[1:-1] & space[:-2]
        finishes = inside[1:-1] & space[2:]
        # A word also begins where its text does, and ends where that ends.
        filled = bounds[:-1] < bounds[1:]
        heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
        begins[heads] = inside[1:-1][heads]
        finishes[tails] = inside[1:-1][tails]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, bounds)
        if hashes:
            self.hash = self._hashes(_BYTE_LOWER if lower else _BYTE)

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        powers, inverse = _power_tables(len(self.data))
        terms = table[self.data]
        terms *= powers
        return mix(np.add.reduceat(terms, self.starts) * inverse[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k words in a row, whatever texts they belong to."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _PLACE[0]
    for i in range(1, k):
        total += words[i : i + n] * _PLACE[i]
    return mix(total)


def sequence_hash(words: np.ndarray) -> int:
    """A hash of a whole word sequence of any length, also of its length."""
    powers, _ = _power_tables(max(1, len(words)))
    total = int((words * powers[: len(words)]).sum(dtype=np.uint64)) if len(words) else 0
    return int(mix(np.array([(total + len(words) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
