"""Word shingles and MinHash signatures, computed a batch of texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(29)


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters, digits or underscore, lower-cased one by one."""
    found = WORD.findall(text)
    return "\0".join(found).lower().split("\0") if found else []


class WordIds(dict):
    """Word -> 64-bit id, memoised; emptied when the vocabulary of a task grows past ``most``."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` successive ids; empty when there are fewer."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n]) * _M1
        h ^= h >> _S
    h = h * _M2
    h ^= h >> _S
    return h * _M3


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` multiply-shift hash functions."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64)


def minhash(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (items x permutations, uint32) of the items whose shingles begin at ``starts`` in ``flat``.

    Every item must own at least one shingle.
    """
    out = np.empty((len(starts), len(a)), np.uint32)
    for k in range(len(a)):
        v = ((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """One signed 64-bit key per item and band of ``rows`` values; the band number is part of the key."""
    bands = sig.shape[1] // rows
    v = sig[:, : bands * rows].astype(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1 + 1000 * salt), v.shape[:2]) * _M3
    for k in range(rows):
        h = (h ^ v[:, :, k]) * _M1
        h ^= h >> _S
    return (h * _M2).view(np.int64)


def batches(rows: Iterable[tuple], size: int = 1000) -> Iterator[list[tuple]]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
