"""Word shingle sets as 64-bit hashes, from whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, n, dtype=np.uint64)


_VALUE = _random(256, 11)
_VALUE[np.arange(65, 91)] = _VALUE[np.arange(97, 123)]  # A-Z as a-z
_VALUE[_IS_SPACE] = 0
_PLACES: dict[int, np.ndarray] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, m in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a byte array."""
    word = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:-1], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of every text; a text with fewer words is one shingle, one without is empty."""
    factors = _PLACES.setdefault(width, _random(width, 23) | np.uint64(1))
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size < _CHUNK):
            b = (texts[at] or "").encode("utf-8", "surrogatepass")
            parts.append(b)
            size += len(b) + 1
            at += 1
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        starts, words = word_hashes(data)
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        first = np.searchsorted(starts, offsets)
        if len(words) >= width:
            n = len(words) - width + 1
            total = np.zeros(n, np.uint64)
            for i in range(width):
                total += words[i : i + n] * factors[i]
            total = mix(total)
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= width:
                yield np.unique(total[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
