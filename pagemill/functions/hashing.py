"""Content addresses: SHA-256 in the JVM, BLAKE3-256 in Python (no library of it is at hand)."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ALGORITHMS = ("sha256", "blake3")

_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_MASK = 0xFFFFFFFF
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv: tuple[int, ...], block: tuple[int, ...], counter: int, size: int, flags: int) -> list[int]:
    v = [*cv, *_IV[:4], counter & _MASK, counter >> 32 & _MASK, size, flags]
    m = list(block)
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_QUARTERS):
            for x, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & _MASK
                t = v[d] ^ v[a]
                v[d] = (t >> r1 | t << 32 - r1) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                t = v[b] ^ v[c]
                v[b] = (t >> r2 | t << 32 - r2) & _MASK
        if turn < 6:
            m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _words(block: bytes) -> tuple[int, ...]:
    return struct.unpack("<16I", block.ljust(64, b"\0"))


def _subtree(data: bytes, first: int) -> tuple:
    """The last compression of a subtree, not yet done: (chaining value, block, counter, size, flags)."""
    if len(data) <= 1024:
        cv, blocks = _IV, max(1, -(-len(data) // 64))
        for i in range(blocks):
            part = data[64 * i : 64 * i + 64]
            flags = (CHUNK_START if i == 0 else 0) | (CHUNK_END if i == blocks - 1 else 0)
            if i == blocks - 1:
                return cv, _words(part), first, len(part), flags
            cv = tuple(_compress(cv, _words(part), first, 64, flags))
    left = 1024 << (((len(data) - 1) // 1024).bit_length() - 1)
    a, b = _subtree(data[:left], first), _subtree(data[left:], first + left // 1024)
    return _IV, (*_compress(*a), *_compress(*b)), 0, 64, PARENT


def blake3_hex(data: bytes) -> str:
    """BLAKE3 of 32 bytes, as hex."""
    cv, block, counter, size, flags = _subtree(data, 0)
    return struct.pack("<8I", *_compress(cv, block, 0 if flags & PARENT else counter, size, flags | ROOT)).hex()


@F.pandas_udf(StringType())
def _blake3(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else blake3_hex(x if isinstance(x, bytes) else x.encode()))


def digest(value: Column | str, algorithm: str = "sha256") -> Column:
    """Hex digest of a string or binary column."""
    c = F.col(value) if isinstance(value, str) else value
    if algorithm == "sha256":
        return F.sha2(c, 256)
    if algorithm == "blake3":
        return _blake3(c)
    raise ValueError(f"unknown hash algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")


def address(value: Column | str, algorithm: str = "sha256") -> Column:
    """``algorithm:hex``."""
    return F.concat(F.lit(f"{algorithm}:"), digest(value, algorithm))


def file_name(canonical_url: Column | str, algorithm: str = "sha256") -> Column:
    """The name a document is kept under: twelve hex digits of its canonical URL's hash."""
    return F.concat(F.substring(digest(canonical_url, algorithm), 1, 12), F.lit(".md"))
