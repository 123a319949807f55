"""Digests of texts, hashes of byte ranges and MinHash signatures, vectorised over a batch of texts.

Only digests (128 bits, cryptographic) may stand for a text. Range hashes are polynomials modulo 2^64,
for which texts that collide can be built; they find candidates, which are compared as texts after.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np

U = np.uint64
_SEED = np.random.default_rng(20240607)
BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random value for each code point.
POINT = mix(np.arange(0x110000, dtype=np.uint64) * BASE + U(0x632BE59BD9B4E019))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def points(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit integers, each in constant time after one pass. For candidates only."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.up = up
        self.prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial hashes, not mixed: a range's is its left part's plus BASE^length times its right part's."""
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def without(self, at: np.ndarray) -> np.ndarray:
        """Hashes, not mixed, of the whole sequence less the one element at each of these places."""
        return self.prefix[at] + self.up[at] * ((self.prefix[-1] - self.prefix[at + 1]) * self.down[at + 1])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


def normal(text: str | None) -> str:
    """Lower case, words separated by one blank."""
    return " ".join((text or "").lower().split())


def digests(texts: list[str]) -> list[bytes]:
    """16 bytes for each text; equal digests mean equal texts."""
    return [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]


def digest_halves(texts: list[str]) -> np.ndarray:
    """(texts, 2) digests as pairs of signed 64-bit integers."""
    return np.frombuffer(b"".join(digests(texts)), dtype="<i8").reshape(-1, 2)


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of normal texts, one text after the other, and where each text starts.

    A text of fewer than n words has one run, all its words; an empty text has none.
    """
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    runs = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    starts = np.concatenate(([0], np.cumsum(runs)))
    buffer = np.frombuffer(" ".join([t for t in texts if t] + [""]).encode(), dtype=np.uint8)
    if not len(buffer):
        return np.zeros(0, dtype=np.uint64), starts
    ends = np.flatnonzero(buffer == 32)
    begins = np.concatenate(([0], ends[:-1] + 1))
    first = np.repeat(np.concatenate(([0], np.cumsum(words)))[:-1], runs) + np.arange(starts[-1]) - np.repeat(starts[:-1], runs)
    last = first + np.repeat(np.minimum(words, n), runs) - 1
    return Ranges(BYTE[buffer])(begins[first], ends[last]), starts


def bands_and_rows(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of so many rows that finds a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class MinHash:
    """Keys of `bands` bands of `rows` MinHash values."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(seed)
        self.times = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1)
        self.plus = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, bands) keys as signed 64-bit integers; a key names its band too. Rows of texts without hashes mean nothing."""
        out = np.zeros((len(starts) - 1, self.bands), dtype=np.uint64)
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            at = starts[:-1][full]
            for b in range(self.bands):
                acc = np.full(len(full), b + 1, dtype=np.uint64)
                for k in range(b * self.rows, (b + 1) * self.rows):
                    acc = mix(acc * BASE + np.minimum.reduceat(hashes * self.times[k] + self.plus[k], at))
                out[full, b] = acc
        return out.view(np.int64)
