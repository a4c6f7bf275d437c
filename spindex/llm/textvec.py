"""Vectorised word splitting and hashing over UTF-8 buffers.

Every word class used by the operators of this subpackage is decided by ASCII
bytes alone (all bytes of a non-ASCII character belong to one side), so words can
be cut and hashed on raw bytes, a megabyte at a time, with no Python object per
word. A word's hash is a polynomial over random byte values modulo 2**64, taken
from prefix sums, and then mixed; equal words give equal hashes in any document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        with np.errstate(over="ignore"):
            _POW[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, m, U64))]) for m in (_MULT, _INV)]
    return _POW[0], _POW[1]


_RESIDENT: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """A large object that this process keeps for further batches. One at a time: a worker serves jobs of all kinds."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true on the given inclusive ranges."""
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Everything but white space in ASCII.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: ASCII letters and every byte of a non-ASCII character.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def binary_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.binary())
    if pa.types.is_string(col.type):
        col = col.view(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.view(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each, or of one longer row."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and each row's first word's index (n + 1 values)."""
    n = len(buf)
    w = table[buf]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = w[:-1]
        after[-1] = False
        after[:-1] = w[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off, side="left")


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the buffer."""
    pw, inv = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(buf) + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[buf] * pw[: len(buf)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inv[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def block_hashes(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of each block of ``size`` consecutive 64-bit values."""
    pw, inv = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(mix(values) * pw[: len(values)], out=sums[1:])
        return mix((sums[starts + size] - sums[starts]) * inv[starts])


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each row's first word's index."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, off, table)
    return span_hashes(buf, starts, ends), first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, rows given by n + 1 bounds; an empty row has 0.

    A row's sum depends on its own values alone, to the last bit, however rows are batched.
    """
    out = np.zeros(len(first) - 1, values.dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, first[some])
    return out


def text_hash(*texts: bytes) -> np.ndarray:
    """Hashes of single byte strings, equal to those of ``words`` for the same bytes."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return span_hashes(buf, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))
