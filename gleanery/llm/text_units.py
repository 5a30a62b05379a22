"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Used inside Arrow tasks. Texts are taken in slices of about a megabyte, so that memory follows the longest text and
not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A slice of a batch is closed once it holds so many bytes.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.uint64([seed]))) | np.uint64(1)


_BYTE = constants(256, 11)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = int(constants(1, 12)[0])
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(2 * SLICE_BYTES, n)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def byte_class(members: bytes) -> np.ndarray:
    """A table over bytes: whether each is one of ``members``."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: White space of the shingle contract: space and \t \n \v \f \r.
WHITE = byte_class(b" \t\n\v\f\r")


@dataclass
class Words:
    """Words of the texts ``first`` ... ``first + n - 1`` of a batch. start, end: in ``raw``; text: index in the slice."""

    first: int
    n: int
    raw: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial; with ``fold``, A-Z and a-z are the same."""
        n = len(self.raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if fold else _BYTE)[self.raw] * powers(_STEP, n), out=sums[1:])
        size = (self.end - self.start).astype(np.uint64)
        return mix((sums[self.end] - sums[self.start]) * powers(_BACK, n + 1)[self.start] + size)

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n)


def _sliced(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, their bytes, bounds in these) of an Arrow string column; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        yield at, to - at, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def slices(texts: pa.Array, between: np.ndarray = WHITE) -> Iterator[Words]:
    """Words between the bytes of ``between``, for all texts of an Arrow string column; null has none."""
    for at, n, own, edge in _sliced(texts):
        inside = np.zeros(len(own) + 2, bool)
        inside[1:-1] = ~between[own]
        first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        # a text ends the word before it, even where no white space stands between
        joint = edge[1:-1][(edge[1:-1] > 0) & (edge[1:-1] < len(own))]
        joint = np.unique(joint[inside[joint] & inside[joint + 1]])
        first[joint] = last[joint] = True
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        yield Words(at, n, own, edge, start, end, np.searchsorted(edge, start, "right") - 1)


#: A byte after which a space cannot be taken to end a unit: white space, or the first byte of what may be.
_NOT_AFTER = WHITE | byte_class(b"\xc2\xe1\xe2\xe3")


def spaced_units(texts: pa.Array) -> Iterator[Words]:
    """Units that cover each text: one ends before a space that something other than white space follows."""
    for at, n, own, edge in _sliced(texts):
        cut = np.zeros(len(own) + 1, bool)
        cut[1 : len(own)] = (own[1:] == 32) & ~_NOT_AFTER[np.concatenate((own[2:], [32]))] if len(own) > 1 else False
        cut[np.maximum(edge[1:] - 1, 0)] = False  # what ends a text is not cut from the white space before it
        cut[edge] = True
        marks = np.flatnonzero(cut)
        yield Words(at, n, own, edge, marks[:-1], marks[1:], np.searchsorted(edge, marks[:-1], "right") - 1)


class UnitTable:
    """Encodings of distinct units, kept between the batches of a worker: values of unit u stand at start[u] and on.

    It is emptied once it holds ``most`` units, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], most: int = 500_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.values = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first value, number of values) of each unit of a slice."""
        distinct, first, which = np.unique(words.hashes(fold=False), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            fresh, raw = np.flatnonzero(~known), words.raw.tobytes()
            got = self.encode([raw[s:e] for s, e in zip(words.start[first[fresh]], words.end[first[fresh]], strict=True)])
            sizes = np.array([len(g) for g in got], np.int64)
            self.order = np.concatenate((self.order, len(self.start) - 1 + np.arange(len(fresh))))
            self.keys = np.concatenate((self.keys, distinct[fresh]))
            by = np.argsort(self.keys, kind="stable")
            self.keys, self.order = self.keys[by], self.order[by]
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
            self.values = np.concatenate([self.values, *got])
            at = np.searchsorted(self.keys, distinct)
        unit = self.order[at][which]
        return self.start[unit], self.start[unit + 1] - self.start[unit]
