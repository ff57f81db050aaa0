"""Word hashing over whole Arrow text columns, shared by the word-based operators.

Texts are handled as UTF-8 bytes. A slice of about a megabyte of whole texts is
lower-cased and split with array operations, and every word gets a 64-bit hash: a
polynomial over random byte values, taken from one running sum, then mixed. Two words
with one hash would count as one word; for n different words that is n**2 / 2**65 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)


def _table(is_word) -> bytes:
    """Byte table: A-Z to a-z, bytes outside words to a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if is_word(b) else 32 for b in range(256))


#: Words are what white space (space, \t \n \v \f \r) leaves.
SPACED = _table(lambda b: b not in (32, 9, 10, 11, 12, 13))
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM = _table(lambda b: b >= 128 or chr(b).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest slice needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, f, U64)])) for f in (_MULTIPLIER, _INVERSE))


_powers = _Powers()


def hash_words(data: bytes, offsets: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds): text i has the words bounds[i]:bounds[i + 1].

    offsets: n + 1 byte offsets of the n texts in data.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    b = np.frombuffer(data.translate(table), np.uint8)
    inside = b != 32
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    _powers.upto(n)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[b] * _powers.up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers.down[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(starts, offsets)


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word sequences; parts[j] has each sequence's j-th word hash."""
    out = np.full(len(parts[0]), len(parts), U64)
    for p in parts:
        out = mix(out * _MULTIPLIER + p)
    return out


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; null is empty.

    A run has at most `most` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = memoryview(raw) if raw is not None else memoryview(b"")
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, bytes(raw[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def hashed_texts(column, table: bytes) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column in turn."""
    for _, _, data, offsets in text_slices(column):
        hashes, bounds = hash_words(data, offsets, table)
        for i in range(len(bounds) - 1):
            yield hashes[bounds[i] : bounds[i + 1]]
