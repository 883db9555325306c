"""Vectorised word splitting and word hashing of whole Arrow text columns.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f, \\r (``[^\\x20\\x09-\\x0D]+``); words never
cross a row.  All helpers work on the Arrow buffers with numpy, so no Python object exists per word, and in blocks of
about ``BLOCK`` bytes, so that working memory does not grow with a text's length beyond a few arrays per word.

Word and window hashes are 64 bits wide: random per-byte values weighted by powers of an odd number modulo 2**64, then
mixed.  ``salt`` chooses an independent hash family (two families together make 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa

BLOCK = 1 << 16
#: Longer tables of powers, for words longer than a block, aren't kept: a worker lives for many tasks.
KEPT = 4 * BLOCK
#: Rows are taken in pieces of about this many text bytes; in smaller ones where words are split, with a dozen arrays per word.
PIECE, TOKENS = 2 << 20, 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64 values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=8)
def _byte_values(salt: int) -> np.ndarray:
    values = np.random.default_rng(1_000_003 + salt).integers(1, 1 << 64, 256, dtype=np.uint64)
    values[_SPACE] = 0
    return values


@lru_cache(maxsize=8)
def _powers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    base = int(np.random.default_rng(2_000_003 + salt).integers(1 << 62, 1 << 63)) * 2 + 1 & (1 << 64) - 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    p, q = (_powers if size <= KEPT else _powers.__wrapped__)(size, salt)
    return p[:n], q[:n]


#: Lower case, and ASCII punctuation and control characters as spaces.
_PLAIN = _LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


class Tokens:
    """Words of some rows.

    ``data`` holds the bytes (A-Z lower-cased if asked; plain: also without ASCII punctuation), ``start``/``end`` each word's byte range, and the words of row r
    are ``first[r]:first[r + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, plain: bool = False):
        self.offsets = offsets
        data = _PLAIN[data] if plain else _LOWER[data] if lower else data
        self.data = data
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[data]
        begin, finish = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = np.unique(offsets[(offsets > 0) & (offsets < n)])
        begin[edge] |= inside[1:-1][edge]
        finish[edge - 1] |= inside[1:-1][edge - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """One hash per word."""
        out = np.empty(len(self.start), dtype=np.uint64)
        values, w = _byte_values(salt), 0
        while w < len(out):
            base = int(self.start[w])
            stop = max(w + 1, int(np.searchsorted(self.end, base + BLOCK, side="right")))
            s, e = self.start[w:stop] - base, self.end[w:stop] - base
            p, q = powers(int(e[-1]) + 1, salt)
            total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
            np.cumsum(values[self.data[base : base + int(e[-1])]] * p[:-1], out=total[1:], dtype=np.uint64)
            out[w:stop] = (total[e] - total[s]) * q[s]
            w = stop
        return mix(out)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The row's words joined by one space; keep: boolean per word of the row."""
        words = self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().split()  # bytes.split() knows the same six spaces
        return b" ".join(words if keep is None else compress(words, keep.tolist()))


def windows(h: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay inside a row, and the index of each window's first word."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= last)
    out = np.empty(len(at), dtype=np.uint64)
    step = BLOCK
    for a in range(0, len(at), step):
        i = at[a : a + step]
        base, stop = int(i[0]), int(i[-1]) + k
        p, q = powers(stop - base + 1, salt + 17)
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(h[base:stop] * p[:-1], out=total[1:], dtype=np.uint64)
        out[a : a + step] = (total[i - base + k] - total[i - base]) * q[i - base]
    return mix(out), at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary Arrow array (null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for consecutive rows of about ``size`` bytes; a longer row comes alone."""
    data, offs = buffers(column)
    r, n = 0, len(offs) - 1
    while r < n:
        stop = max(r + 1, int(np.searchsorted(offs, offs[r] + size, side="right")) - 1)
        yield r, stop, data[offs[r] : offs[stop]], offs[r : stop + 1] - offs[r]
        r = stop


def tokens(column: pa.Array, lower: bool = False, size: int = TOKENS, plain: bool = False) -> Iterator[tuple[int, int, Tokens]]:
    for a, b, data, offs in pieces(column, size):
        yield a, b, Tokens(data, offs, lower, plain)
