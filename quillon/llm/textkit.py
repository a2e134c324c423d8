"""Vectorised word hashing over Arrow string buffers.

Everything here works on the raw UTF-8 buffer of an Arrow batch, so that no Python string
is made per row or per word.  A word is a maximal run of bytes that a 256-entry table
accepts; a run never crosses a row.  Hashes are polynomial over the ring of 64-bit
integers with an odd base, whose powers can be inverted, so the hash of any range follows
from two prefix sums.  Such hashes are weak for long runs of few letters (words of the Thue-Morse
kind collide from 1,024 letters on), so words over LONG_WORD bytes are hashed by a digest.
`Words.second` is a further hash of each word, of other values and another base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
BASE_2, WORD_BASE_2 = 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1
#: Bytes of a word from which on it is hashed by a digest.
LONG_WORD = 64
#: Bytes of text that are hashed at a time: a few 8-byte arrays of this length are alive.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


#: Powers that stay in memory: what slices need; longer rows make their own.
KEPT_POWERS = 1 << 20
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(size, base, U64)
    steps[0] = 1
    back = np.full(size, pow(base, -1, 1 << 64), U64)
    back[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(back)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below a bound not under size."""
    have = _kept.get(base)
    if have is None or len(have[0]) < size:
        have = _powers(base, 1 << max(16, (size - 1).bit_length()))
        if len(have[0]) <= KEPT_POWERS:
            _kept[base] = have
    return have


@lru_cache(maxsize=2)
def byte_values(second: bool = False) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xE7037ED1A0B428DB if second else 0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(data)
    up, back = powers(BASE_2 if second else BASE, n + 1)
    values = byte_values(second) if fold is None else byte_values(second)[fold]
    prefix = np.zeros(n + 1, U64)
    np.cumsum(values[data] * up[:n], out=prefix[1:])
    out = mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(U64))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        raw = data[start[k] : end[k]]
        digest = blake2b((raw if fold is None else fold[raw].astype(np.uint8)).tobytes(), digest_size=16).digest()
        out[k] = int.from_bytes(digest[8:] if second else digest[:8], "little")
    return out


@dataclass
class Words:
    """Words of a run of rows: byte ranges, first word of each row, hashes."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    fold: np.ndarray | None = None

    @cached_property
    def hash(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, self.fold)

    @cached_property
    def second(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, self.fold, True)

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of each row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return held, bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone."""
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int, accept: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Words of rows lo to hi.  accept: which bytes belong to words; fold: a byte map before hashing."""
    bounds = bounds[lo : hi + 1]
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    n = len(data)
    inside = accept[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    before &= ~edge[:n]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    if n:
        after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), fold)


def grams(w: Words, size: int, second: bool = False) -> np.ndarray:
    """Hash of the `size` words from each word on; junk where they cross a row's end.  second: from the second hashes, with another base."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, U64)
    up, back = powers(WORD_BASE_2 if second else WORD_BASE, n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((w.second if second else w.hash) * up[:n], out=prefix[1:])
    return mix((prefix[size:] - prefix[: n - size + 1]) * back[: n - size + 1])


def room(w: Words, size: int) -> np.ndarray:
    """Whether `size` words fit in the row from each gram's first word on."""
    left = np.repeat(w.first[1:], np.diff(w.first))[: max(0, len(w.hash) - size + 1)]
    return np.arange(len(left)) + size <= left


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return out if not rest else np.minimum(out[: len(out) - rest], out[rest:])


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions lie in a range of `length` from one of the starts."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, np.minimum(start + length, n), -1)
    return np.cumsum(mark[:n]) > 0


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array by significance, which compress well when high ones agree."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)
