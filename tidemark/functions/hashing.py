"""Hash functions as columns that other engines can repeat: a*x + b modulo the prime 2**31 - 1."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def coefficients(n: int, seed: int) -> list[tuple[int, int]]:
    """n pairs (a, b) with 0 < a, b < PRIME, from a 64-bit congruential generator."""
    x, out = (seed * 2862933555777941757 + 3037000493) % 2**64, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def number(key: Column, text: bool = False) -> Column:
    """A key as an integer below PRIME: integers modulo PRIME, texts by sixty bits of their MD5."""
    if text:
        key = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(key.cast("long"), F.lit(PRIME))


def hashed(x: Column, ab: tuple[int, int], width: int | None = None) -> Column:
    """x is below PRIME, so that the product stays below 2**62."""
    h = (F.lit(ab[0]).cast("long") * x + F.lit(ab[1]).cast("long")) % F.lit(PRIME).cast("long")
    return h if width is None else h % F.lit(width).cast("long")


def hashed_sql(x: str, ab: tuple[int, int], width: int | None = None) -> str:
    h = f"(({ab[0]}::BIGINT * (({x})::BIGINT % {PRIME}) + {ab[1]}) % {PRIME})"
    return h if width is None else f"({h} % {width})"


def text_number_sql(x: str) -> str:
    return f"(cast('0x' || substr(md5(cast({x} AS VARCHAR)), 1, 15) AS BIGINT) % {PRIME})"


def random_signs(n: int, seed: int) -> list[float]:
    """n independent signs, from the digests of numbered texts."""
    return [1.0 if int(hashlib.md5(f"{seed}_{k}".encode()).hexdigest()[:15], 16) % 2 else -1.0 for k in range(n)]


def random_sign_sql(k: str, seed: int) -> str:
    return f"CASE WHEN cast('0x' || substr(md5('{seed}_' || ({k})::VARCHAR), 1, 15) AS BIGINT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def text_number(key: str) -> int:
    """number(key, text=True) of one value."""
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % PRIME


def hash_of(x: int, ab: tuple[int, int], width: int) -> int:
    """hashed() of one value."""
    return (ab[0] * x + ab[1]) % PRIME % width


def trailing_zeros(x: Column) -> Column:
    """The number of zero bits below the lowest one bit of a positive integer."""
    return F.bit_count(x.bitwiseAND(-x) - 1)
