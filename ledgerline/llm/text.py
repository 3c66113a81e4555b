"""Shared helpers: words of Arrow text columns as numpy arrays, and joins with small tables.

Words are cut on bytes: every separator of the word classes below is an
ASCII character, and all bytes of a multi-byte UTF-8 character are >= 0x80,
so cutting bytes and cutting characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words ``[^\x20\x09-\x0D]+``: everything between spaces.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: ASCII letters, digits, all else beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: The same two classes as regular expressions for Spark SQL.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits (uint64 in, uint64 out)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, _PIECE)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.full(m, _BASE, np.uint64)]).cumprod()
                self.down = np.concatenate([[np.uint64(1)], np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod()
        return self.up, self.down


_POWERS = _Powers()


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def texts_of(col: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text (null: no bytes), without a copy."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if data is None:
        for _ in range(len(col)):
            yield np.empty(0, np.uint8)
        return
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)
    null = col.is_null().to_numpy(zero_copy_only=False) if col.null_count else None
    for i in range(len(col)):
        yield raw[:0] if null is not None and null[i] else raw[o[i]:o[i + 1]]


def word_bounds(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of each maximal run of word bytes."""
    m = np.empty(len(buf) + 2, dtype=np.int8)
    m[0] = m[-1] = 0
    m[1:-1] = inside[buf]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands.

    Prefix sums of byte * base**position, taken over pieces of about a
    megabyte, so that a long text needs no arrays of eight times its size.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, side="right")))
        a, z = int(starts[i]), int(ends[j - 1])
        up, down = _POWERS.upto(z - a)
        s = np.zeros(z - a + 1, dtype=np.uint64)
        np.cumsum((buf[a:z].astype(np.uint64) + np.uint64(1)) * up[:z - a], out=s[1:])
        lo, hi = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64)
        i = j
    return mix64(out)


def slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of a byte array as an Arrow string column."""
    sizes = ends - starts
    offs = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offs[1:])
    at = np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(raw[at])])


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that :func:`word_hashes` gives these words."""
    out = np.empty(len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        b = np.frombuffer(w.encode(), np.uint8)
        out[k] = word_hashes(b, np.array([0]), np.array([len(b)]))[0]
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that added columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


#: Rows up to which a measured table is broadcast; a larger one takes a shuffle join.
BROADCAST_ROWS = 100_000


def join_counted(big: DataFrame, small: DataFrame, on, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a written table ``small``; broadcast it only if its counted rows are within ``bound``.

    ``small`` must be cheap to count (a staged table with narrow rows).  The
    rows returned are the same either way.
    """
    return big.join(F.broadcast(small) if small.count() <= bound else small, on, how)
