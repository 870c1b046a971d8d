"""Vectorised byte kernels shared by the corpus operators.

Every kernel works straight on the buffers of an Arrow string array, so that a
batch of texts is never turned into Python strings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_M1 = U64(0xBF58476D1CE4E5B9)
_M2 = U64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):  # numbers alone warn, arrays don't
        z = np.asarray(x, dtype=U64) + _GOLD
        z = (z ^ (z >> U64(30))) * _M1
        z = (z ^ (z >> U64(27))) * _M2
        return z ^ (z >> U64(31))


def uniform(seed: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and counter alone."""
    c = np.asarray(counter).astype(U64)
    bits = mix64(np.asarray(seed, dtype=U64) ^ mix64(c)) >> U64(11)
    return (bits.astype(np.float64) + 0.5) * (1.0 / (1 << 53))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(256, dtype=U64) * U64(0x2545F4914F6CDD1D) + U64(77))


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class ShortHash:
    """Hashes of short ranges of a sequence, by one prefix sum modulo 2^64.

    Sequences of 1,024 values and more can be made whose hashes collide whatever
    the base; RangeHash is for those.
    """

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        up, self._down = _POWERS.upto(n + 1)
        self._prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * up[:n], out=self._prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._prefix[end] - self._prefix[start]) * self._down[start])


#: The modulus of RangeHash.
_P = U64((1 << 61) - 1)
_LOW = U64((1 << 32) - 1)
_LOW29 = U64((1 << 29) - 1)


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1."""
    x = (x & _P) + (x >> U64(61))
    x -= (x >= _P) * _P
    return x


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers of which one is below it, the other below four times it."""
    a0, a1, b0, b1 = a & _LOW, a >> U64(32), b & _LOW, b >> U64(32)
    low, middle, high = a0 * b0, a1 * b0 + a0 * b1, a1 * b1
    return _rest((high << U64(3)) + (middle >> U64(29)) + ((middle & _LOW29) << U64(32)) + (low & _P) + (low >> U64(61)))


class _PrimePowers:
    """Powers of a base and of its inverse modulo 2^61 - 1; those of the base also cut in two."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)
        self.low, self.high = self.up & _LOW, self.up >> U64(32)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            for name, base in (("up", _BASE % int(_P)), ("down", pow(_BASE % int(_P), -1, int(_P)))):
                setattr(self, name, np.concatenate([getattr(self, name), mulmod(getattr(self, name), np.full(1, pow(base, size, int(_P)), dtype=U64))]))
            self.low, self.high = self.up & _LOW, self.up >> U64(32)


_PRIME_POWERS = _PrimePowers()


class RangeHash:
    """Hashes of any range of a sequence of bytes or of 64-bit values, by one prefix sum modulo the prime 2^61 - 1."""

    #: Values whose parts are summed before the sums are reduced.
    _SUMMED = 1 << 22

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        powers = _PRIME_POWERS
        powers.upto(n + 1)
        self._down = powers.down
        self._low, self._high = np.zeros(n + 1, dtype=U64), np.zeros(n + 1, dtype=U64)
        for a in range(0, n, self._SUMMED):
            z = min(n, a + self._SUMMED)
            if values.dtype == np.uint8:  # the parts of a product stay far below 2^64
                v = values[a:z].astype(U64)
                v += U64(1)
                parts = v * powers.low[a:z], v * powers.high[a:z]
            else:
                product = mulmod(_rest(values[a:z]), powers.up[a:z])
                parts = product & _LOW, product >> U64(32)
            for total, part in zip((self._low, self._high), parts, strict=True):
                np.cumsum(part, out=total[a + 1 : z + 1])
                if a:
                    total[a + 1 : z + 1] += _rest(total[a : a + 1])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low = self._low[end] + (_P << U64(2)) - self._low[start]
        high = self._high[end] + (_P << U64(2)) - self._high[start]
        apart = (low & _P) + (low >> U64(61)) + ((high & _LOW29) << U64(32)) + (high >> U64(29))
        return mix64(mulmod(apart, self._down[start]))


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # a C library without it
    _TRIM = None


def release() -> None:
    """Give memory that is free, but kept by the allocators for later, back to the system: a worker lives on, and its next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


#: Bytes of texts after which a worker releases memory.
_RELEASED = 1 << 23

_passed = 0


def _pass(some: int) -> None:
    global _passed
    _passed += some
    if _passed >= _RELEASED:
        _passed = 0
        release()


class Chunk:
    """Rows lo..hi of a batch: their bytes, and where each row starts and ends."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, bounds: np.ndarray, valid: np.ndarray) -> None:
        self.lo, self.hi, self.data, self.bounds, self.valid = lo, hi, data, bounds, valid

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[Chunk]:
    """Consecutive rows of about `most` bytes, one longer row at least; nulls count as empty."""
    arr = as_array(column)
    if len(arr) == 0:
        return
    if pa.types.is_null(arr.type):
        arr = arr.cast(pa.string())
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    valid = ~arr.is_null().to_numpy(zero_copy_only=False).astype(bool)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), len(arr))
        own = offsets[lo : hi + 1]
        yield Chunk(lo, hi, data[own[0] : own[-1]], own - own[0], valid[lo:hi])
        _pass(int(own[-1] - own[0]))
        lo = hi


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true cells; no run passes a bound."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | cut[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def row_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row in which each position lies."""
    return np.searchsorted(bounds, starts, side="right") - 1


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] times, then those of the next."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - counts), counts)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters in UTF-8; lengths stay."""
    out = _FOLD[data]
    if len(out) > 1:
        second = out[1:]
        upper = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[upper] += 0x20
    return out


class HashTable:
    """A fixed map from distinct 64-bit keys to places, probed in vectors."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys, dtype=U64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        size = 1 << self.bits
        self.key = np.zeros(size, dtype=U64)
        self.place = np.full(size, -1, dtype=np.int32)
        self._mask = size - 1
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.place[at] < 0
            trying, where = todo[free], at[free]
            self.place[where] = trying
            won = self.place[where] == trying
            self.key[where[won]] = keys[trying[won]]
            lost = np.concatenate([todo[~free], trying[~won]])
            slot[lost] = (slot[lost] + 1) & self._mask
            todo = lost

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLD) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is absent."""
        keys = np.asarray(keys, dtype=U64)
        slot = self._slot(keys)
        got = self.place[slot]
        wrong = np.flatnonzero((got >= 0) & (self.key[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self._mask
            s = slot[wrong]
            got[wrong] = self.place[s]
            wrong = wrong[(got[wrong] >= 0) & (self.key[s] != keys[wrong])]
        return got


def to_list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of an array as binary cells."""
    values = np.ascontiguousarray(values)
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(np.asarray(counts) * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
