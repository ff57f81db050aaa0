"""Elias-Fano coded monotone sequences, queried in bulk from memory-mapped bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_LOW_BITS = 56  # so that a low part lies in eight bytes, whatever bit it starts at
_POPULATION = np.array([bin(b).count("1") for b in range(256)], np.int64)
_SELECT = np.array([[*(k for k in range(8) if b >> k & 1), *[0] * (8 - bin(b).count("1"))] for b in range(256)], np.int64)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word."""
    place, open_ = np.zeros(len(words), np.int64), np.ones(len(words), bool)
    k = k.copy()
    for j in range(8):
        byte = ((words >> U64(8 * j)) & U64(255)).astype(np.int64)
        n = _POPULATION[byte]
        here = open_ & (k < n)
        place[here] = 8 * j + _SELECT[byte[here], k[here]]
        open_ &= ~here
        k[open_] -= n[open_]
    return place


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values.

    Each value's low bits are packed; the high parts are one bit string in which value i sets bit
    high + i, so the bits before a zero tell how many values have a smaller high part.
    """

    def __init__(self, header: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.bits, self.base = int(header[0]), int(header[1]), header[2]
        self.header, self.low, self.high = header, low, high
        self._bytes = np.ndarray(max(0, low.nbytes - 7), "<u8", buffer=low.data, strides=(1,)) if low.nbytes else np.empty(0, U64)
        ones = _POPULATION[np.asarray(high).view(np.uint8)].reshape(-1, 8).sum(1) if len(high) else np.empty(0, np.int64)
        self._ones = np.concatenate([[0], np.cumsum(ones)])
        self._zeros = 64 * np.arange(len(self._ones)) - self._ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        if n == 0:
            return cls(np.zeros(3, U64), np.empty(0, U64), np.empty(0, U64))
        base = values[0]
        rest = values - base
        bits = min(_LOW_BITS, max(0, (int(rest[-1]) // n).bit_length() - 1))
        at = np.arange(n, dtype=np.int64)
        low = np.zeros(n * bits // 64 + 3, U64)
        if bits:
            part, place = rest & U64((1 << bits) - 1), at * bits
            word, shift = place >> 6, (place & 63).astype(U64)
            np.add.at(low, word, part << shift)
            over = shift + U64(bits) > U64(64)
            np.add.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        tops = (rest >> U64(bits)).astype(np.int64)
        flags = np.zeros((n + int(tops[-1]) + 1 + 63) // 64 * 64, np.uint8)
        flags[tops + at] = 1
        return cls(np.array([n, bits, base], U64), low, np.packbits(flags, bitorder="little").view(U64))

    def to_arrays(self) -> list[np.ndarray]:
        return [self.header, self.low, self.high]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        place = i * self.bits
        return (self._bytes[place >> 3] >> (place & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, U64)
        word = np.searchsorted(self._ones, i, side="right") - 1
        high = 64 * word + _select_in_word(self.high[word], i - self._ones[word]) - i
        return ((high.astype(U64) << U64(self.bits)) | self._low(i)) + self.base

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part; high is at most the largest plus one."""
        k = high - 1
        word = np.maximum(np.searchsorted(self._zeros, k, side="right") - 1, 0)
        place = 64 * word + _select_in_word(~self.high[word], np.maximum(k - self._zeros[word], 0))
        return np.where(high == 0, 0, place - k)

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x; n where there is none."""
        x = np.asarray(x, U64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        rest = np.where(x > self.base, x - self.base, U64(0))
        top = self[np.array([self.n - 1])][0] - self.base
        beyond = rest > top
        rest = np.minimum(rest, top)
        high, low = (rest >> U64(self.bits)).astype(np.int64), rest & U64((1 << self.bits) - 1)
        a = self._before(high)
        last = high == int(top >> U64(self.bits))
        b = np.full(len(x), self.n, np.int64)
        b[~last] = self._before(high[~last] + 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        a[beyond] = self.n
        return a

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of a value equal to x, or -1."""
        at = self.next_geq(x)
        have = np.flatnonzero(at < self.n)
        at[at >= self.n] = -1
        wrong = self[at[have]] != np.asarray(x, U64)[have]
        at[have[wrong]] = -1
        return at


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each 8-byte aligned, behind a table of their kinds and sizes."""
    kinds = [a.dtype.str.lstrip("<|").ljust(2)[:2].encode() for a in arrays]
    head = len(arrays).to_bytes(8, "little") + b"".join(k + bytes(6) + len(a).to_bytes(8, "little") for k, a in zip(kinds, arrays, strict=True))
    return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


def unpack(buffer) -> list[np.ndarray]:
    """The arrays of pack() as views of a buffer or a memory map."""
    raw = np.frombuffer(buffer, np.uint8) if not isinstance(buffer, np.ndarray) else buffer
    count = int(raw[:8].view("<u8")[0])
    at, out = 8 + 16 * count, []
    for k in range(count):
        entry = raw[8 + 16 * k : 24 + 16 * k]
        kind, n = np.dtype("<" + bytes(entry[:2]).decode().strip()), int(entry[8:].view("<u8")[0])
        out.append(raw[at : at + n * kind.itemsize].view(kind))
        at += (n * kind.itemsize + 7) // 8 * 8
    return out
