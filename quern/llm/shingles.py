"""Word shingles as sorted sets of 64-bit hashes, and MinHash signatures of them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
_REMEMBERED = 150_000
_U = np.uint64
_MIX = [_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)]


class _WordHashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = value
        return value


_HASH_OF = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingles: hashes of each run of ``words`` lower-case words between
    white space. A shorter text is one shingle of all its words; one without a word has none."""
    split = (text or "").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH_OF.__getitem__, split), np.uint64, len(split))
    k = min(words, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * _MIX[2] + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class MinHash:
    """Signatures of ``bands`` hashes, each of ``rows`` minima."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (draw.integers(0, 2**63, bands * rows, dtype=np.uint64) << _U(1) | _U(1))[:, None]
        self.b = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 4096):
            x = hashes[None, at : at + 4096] * self.a
            x += self.b
            low = np.minimum(low, x.min(1))
        low = low.reshape(self.bands, self.rows)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            acc = mix(acc * _MIX[2] + low[:, j])
        return acc.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
