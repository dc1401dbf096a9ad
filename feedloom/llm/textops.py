"""Vectorised work on UTF-8 text: words, n-gram hashes and ranges, over whole Arrow columns.

A hash has two lanes, each a polynomial modulo the prime 2**31 - 1 with a random
base over random values, taken from prefix sums, so that the hash of any range
costs two lookups a lane.  Unlike polynomials modulo a power of two, a prime
modulus has no strings that meet whatever the base: two different ranges of n
values meet with a chance of (n / 2**31) ** 2 at most.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept

U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


#: The modulus, and the bits of a lane.
P, LANE = U((1 << 31) - 1), U(31)


@functools.cache
def byte_values(seed: int) -> np.ndarray:
    """62 random bits for each byte, 31 a lane."""
    return np.random.default_rng(1000 + seed).integers(1, 1 << 62, 256, dtype=np.int64).astype(U)


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & P) + (x >> LANE)


def _reduced(x: np.ndarray) -> np.ndarray:
    """The least remainder modulo P, of values below 2**63."""
    x = _fold(_fold(x))
    return np.where(x >= P, x - P, x)


def _series(base: int, size: int) -> np.ndarray:
    out, have = np.ones(size, U), 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = _reduced(out[:more] * U(pow(base, have, int(P))))
        have += more
    return out


def powers(seed: int, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a lane's base and of its inverse, at least n of each."""
    tables = kept("powers", dict)
    have = tables.get((seed, lane))
    if have is None or len(have[0]) < n:
        base = int(np.random.default_rng([seed, lane]).integers(1 << 20, int(P) - 1))
        size = 1 << max(16, int(n - 1).bit_length())
        tables[seed, lane] = have = _series(base, size), _series(pow(base, -1, int(P)), size)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: Values that are worked on at a time, so that they stay in a core's cache.
CHUNK = 1 << 14


def _fold_in(x: np.ndarray, spare: np.ndarray) -> None:
    np.right_shift(x, LANE, out=spare)
    np.bitwise_and(x, P, out=x)
    np.add(x, spare, out=x)


class Prefix:
    """Prefix sums over a sequence of values of 62 bits or more; ``of(a, b)`` hashes the ranges [a, b), ``slide(size)`` all of one size.

    With ``table``, the values are those that it has for the sequence.
    """

    def __init__(self, values: np.ndarray, seed: int, table: np.ndarray | None = None):
        n = len(values)
        factors = [powers(seed, lane, n + 1) for lane in (0, 1)]
        self.lanes = [(np.zeros(n + 1, U), down) for _, down in factors]
        x, spare, last = np.empty(CHUNK, U), np.empty(CHUNK, U), [U(0), U(0)]
        for i in range(0, n, CHUNK):
            part = values[i : i + CHUNK] if table is None else table[values[i : i + CHUNK]]
            m = len(part)
            v, w = x[:m], spare[:m]
            for lane, (up, _) in enumerate(factors):
                np.right_shift(part, LANE * U(lane), out=v)
                np.bitwise_and(v, P, out=v)
                np.multiply(v, up[i : i + m], out=v)
                _fold_in(v, w)
                v[0] += last[lane]
                sums = self.lanes[lane][0][i + 1 : i + m + 1]
                np.cumsum(v, out=sums)
                last[lane] = sums[-1]

    def _ranges(self, n: int, low, high, by) -> np.ndarray:
        """Hashes from what ``low`` and ``high`` give of the sums, and ``by`` of the inverse powers, for a slice of n places."""
        out, x, spare = np.empty(n, U), np.empty(CHUNK, U), np.empty(CHUNK, U)
        for i in range(0, n, CHUNK):
            got = out[i : i + CHUNK]
            m = len(got)
            w = spare[:m]
            for lane, (sums, down) in enumerate(self.lanes):
                v = x[:m] if lane else got
                np.subtract(high(sums, i, m), low(sums, i, m), out=v)
                _fold_in(v, w)
                _fold_in(v, w)
                np.multiply(v, by(down, i, m), out=v)
                _fold_in(v, w)
                _fold_in(v, w)
                np.subtract(v, P, out=w)
                np.minimum(v, w, out=v)
            np.left_shift(got, LANE, out=got)
            np.bitwise_or(got, x[:m], out=got)
            got[:] = mix(got)
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = lambda s, i, m: s.take(a[i : i + m])
        return self._ranges(len(a), low, lambda s, i, m: s.take(b[i : i + m]), low)

    def slide(self, size: int) -> np.ndarray:
        low = lambda s, i, m: s[i : i + m]
        return self._ranges(max(0, len(self.lanes[0][0]) - size), low, lambda s, i, m: s[i + size : i + size + m], low)


def buffers(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that stay within a document, and each document's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = off[:-1][off[:-1] < n]
    first[cuts] = inside[cuts]
    cuts = off[1:][off[1:] > 0] - 1
    last[cuts] = inside[cuts]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(a, off)


class Words:
    """The words of some documents: ``hash`` of each, and ``at``, each document's first word (one more at the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: np.ndarray = SAME, blank: np.ndarray = BLANK, seed: int = 0):
        a, b, self.at = runs(~blank[data], off)
        self.start, self.end = a, b
        self.n = np.diff(self.at)
        self.hash = Prefix(data, seed, byte_values(seed)[fold]).of(a, b)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(len(a)) - self.at[:-1][self.doc] if len(a) else np.zeros(0, np.int64)


#: Bytes of a slice where a worker must stay small: tables of powers then have 2**18 entries.
SLICE = (1 << 18) - 1


def pieces(n_bytes: np.ndarray, most: int = 1 << 20):
    """Slices of consecutive documents: ``most`` bytes each at most, or one document that has more."""
    ends = np.cumsum(n_bytes)
    lo = done = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """A mask of n places that some range [start, start + length) covers."""
    if not len(starts):
        return np.zeros(n, bool)
    d = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def planes(x: np.ndarray) -> bytes:
    """All first bytes of some values, then all second ones, and so on: what is sorted or small then compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def unplaned(x, kind) -> np.ndarray:
    raw = np.frombuffer(x, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
