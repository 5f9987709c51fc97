"""Words and characters of whole texts, on bytes.

``bytes.lower`` maps A-Z alone and ``bytes.split`` cuts at exactly \\x20 and \\x09-\\x0D, so
both follow the contracts' ASCII definitions for any UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_MIX = [_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)]


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's end)."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word, the same on every machine."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive words, in order."""
    n = len(hashes) - width + 1
    out = mix(hashes[:n] + _MIX[2])
    for k in range(1, width):
        out = mix(out * _U(3) + hashes[k : k + n])
    return out


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """The set of hashed word windows, sorted; of a shorter text the whole sequence; else empty."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        return windows(hashes, len(words)) ^ _U(len(words))
    return np.unique(windows(hashes, width))
