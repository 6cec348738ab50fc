"""Hash functions used by the detectors.

* ``md5_32``: first 32 bits of the md5 hex digest, as a non-negative bigint.
* ``md5_mod``: the full 128-bit md5 value reduced modulo 2^32-1. Because
  2^32 = 1 (mod 2^32-1), that equals the sum of the digest's four 32-bit words
  modulo 2^32-1, so no 128-bit arithmetic is needed.
* ``murmur3_32``: MurmurHash3 x86 32-bit (seed 0, unsigned), applied by a
  vectorised UDF to a *distinct vocabulary*, never to every token.
* MinHash coefficients: derived from a seed, so both engines agree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERSENNE_32 = (1 << 32) - 1  # modulus of the MinHash family, 2^32 - 1


def md5_32(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def _hex_half(hex_col: Column, i: int) -> Column:
    """The sum of the two 32-bit words of one half of a digest (read as a signed 64-bit number)."""
    v = F.conv(F.substring(hex_col, 16 * i + 1, 16), 16, -10).cast("bigint")
    return F.shiftrightunsigned(v, 32) + v.bitwiseAND(F.lit(MERSENNE_32))


def md5_mod(c: Column) -> Column:
    h = F.md5(c)
    return F.pmod(_hex_half(h, 0) + _hex_half(h, 1), F.lit(MERSENNE_32))


def md5_32_py(s: str) -> int:
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)


@lru_cache(maxsize=32)
def minhash_coefficients(num_hashes: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)`` arrays, each value in [1, 2^32-2], from md5 of ``a:seed:i``."""
    a = np.array([1 + md5_32_py(f"a:{seed}:{i}") % (MERSENNE_32 - 1) for i in range(num_hashes)],
                 dtype=np.uint64)
    b = np.array([1 + md5_32_py(f"b:{seed}:{i}") % (MERSENNE_32 - 1) for i in range(num_hashes)],
                 dtype=np.uint64)
    return a, b


def minhash_coefficients_sql(num_hashes: int, seed: int = 42) -> str:
    """The same coefficient table as a DuckDB query ``(i, a, b)``."""
    return (
        "SELECT i, "
        f"1 + (('0x' || substr(md5('a:{seed}:' || i), 1, 8))::BIGINT % 4294967294) AS a, "
        f"1 + (('0x' || substr(md5('b:{seed}:' || i), 1, 8))::BIGINT % 4294967294) AS b "
        f"FROM range({num_hashes}) t(i)")


# ---------------------------------------------------------------- murmur3 ---

def _rotl32(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, unsigned result (public-domain algorithm)."""
    c1, c2 = 0xCC9E2D51, 0x1B873593
    h = seed & 0xFFFFFFFF
    n = len(data)
    nblocks = n // 4
    for i in range(nblocks):
        k = int.from_bytes(data[4 * i:4 * i + 4], "little")
        k = (k * c1) & 0xFFFFFFFF
        k = _rotl32(k, 15)
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
        h = _rotl32(h, 13)
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    tail = data[4 * nblocks:]
    k = 0
    if len(tail) >= 3:
        k ^= tail[2] << 16
    if len(tail) >= 2:
        k ^= tail[1] << 8
    if len(tail) >= 1:
        k ^= tail[0]
        k = (k * c1) & 0xFFFFFFFF
        k = _rotl32(k, 15)
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
    h ^= n
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & 0xFFFFFFFF
    h ^= h >> 16
    return h


@F.pandas_udf(T.LongType())
def murmur3_32_udf(s: pd.Series) -> pd.Series:
    return pd.Series([murmur3_32(x.encode("utf-8")) for x in s], dtype="int64")


def term_hash32(c: Column, method: str = "murmur3") -> Column:
    """32-bit unsigned term hash as bigint: ``murmur3`` (parity) or ``md5``."""
    if method == "murmur3":
        return murmur3_32_udf(c)
    if method == "md5":
        return md5_32(c)
    raise ValueError("hash must be 'murmur3' or 'md5'")
