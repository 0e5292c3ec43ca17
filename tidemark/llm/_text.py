"""Whole batches of texts as numpy bytes: words, their hashes and shingles without a Python loop over words."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
M64 = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, (n - 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers, in place on a copy."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and what they hold counts as the executor's."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges (from, to) of at most about `most` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
    trim()


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not white space) and the first word of each row (one more than rows)."""
    black = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    starts = black.copy()
    starts[1:] &= ~black[:-1] | first[1:-1]
    ends = black.copy()
    ends[:-1] &= ~black[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def rolling(buf: np.ndarray) -> np.ndarray:
    """Running polynomial modulo 2**64, one more than bytes. Cheap, but some long strings collide whatever the base: only to find candidates
    whose bytes are compared afterwards."""
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=h[1:])
    return h


def rolled(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    x = (h[e] - h[s]) * powers(len(h))[1][s]
    return mixed(x + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


STRETCH = 1 << 20  # bytes whose polynomial is summed up before it is reduced
FIELDS = ((2147483647, 1482657193), (2147483629, 719302181))  # primes and bases of two polynomials


@lru_cache(maxsize=8)
def _field_powers(prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo a prime for i up to STRETCH."""
    out = []
    for b in (base, pow(base, -1, prime)):
        p = np.ones(STRETCH + 1, np.uint64)
        have = 1
        while have <= STRETCH:
            more = min(have, STRETCH + 1 - have)
            p[have : have + more] = p[:more] * np.uint64(pow(b, have, prime)) % np.uint64(prime)
            have += more
        out.append(p)
    return out[0], out[1]


def prefix_hash(buf: np.ndarray) -> list[np.ndarray]:
    """Running polynomials modulo two primes, each one longer than the bytes."""
    out = []
    for prime, base in FIELDS:
        q = np.uint64(prime)
        up = _field_powers(prime, base)[0]
        h, carry = np.zeros(len(buf) + 1, np.uint32), np.uint64(0)
        for low in range(0, len(buf), STRETCH):
            part = buf[low : low + STRETCH]
            x = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]) % q
            if low:
                x = (x * np.uint64(pow(base, low, prime)) + carry) % q
            h[low + 1 : low + 1 + len(part)] = x
            carry = x[-1]
        out.append(h)
    return out


def span_hash(h: list[np.ndarray], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes from s to e, whatever stands before them; the length is part of it."""
    both = None
    for (prime, base), own in zip(FIELDS, h):
        q = np.uint64(prime)
        down = _field_powers(prime, base)[1]
        x = (own[e].astype(np.uint64) + (q - own[s])) % q
        if len(own) <= STRETCH + 1:
            x = x * down[s] % q
        else:
            far = np.array([pow(base, -k * STRETCH, prime) for k in range(len(own) // STRETCH + 1)], np.uint64)
            x = x * down[s % STRETCH] % q * far[s // STRETCH] % q
        both = x if both is None else (both << np.uint64(32)) | x
    return mixed(both + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside a row, and the first of each row (one more than rows).

    A row with fewer words, but one at least, has a single shingle of all its words; a row without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    have = np.repeat(np.minimum(n, width), count)
    out = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([word_hash, np.zeros(width, np.uint64)])
    short = bool((have < width).any())
    for j in range(width):
        part = padded[start + j] * np.uint64(pow(BASE, j + 1, 1 << 64))
        out += np.where(have > j, part, np.uint64(0)) if short else part
    return mixed(out), at


def shingle_rows(column: pa.Array, width: int = 5):
    """For each part of a text column: row range, words per row, word hashes, first word of rows, shingle hashes, first shingle of rows. A-Z count as a-z."""
    data, offsets = raw(column)
    for i, j in pieces(offsets):
        buf, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, first = words(buf, at)
        wh = span_hash(prefix_hash(buf), s, e)
        sh, sat = shingles(wh, first, width)
        yield i, j, np.diff(first), wh, first, sh, sat
