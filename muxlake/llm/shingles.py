"""64-bit hashes of words and of word n-grams, for many texts at once.

A word's bytes give a polynomial hash, taken from running sums over the bytes of all texts, and then mixed. Words
are what lies between the six ASCII white-space characters, in lower case.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers = made[0], made[1]
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and the number of words of each text."""
    raw = [(t or "").lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    white = _WHITE[data]
    edge = np.diff(white.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)])])
    words = mixed((total[end] - total[start]) * inverse[start])
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return words, np.diff(np.searchsorted(start, ends), prepend=0)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; of fewer words, one hash of all; of none, none."""
    size = min(n, len(words))
    if not size:
        return words
    runs = len(words) - size + 1
    out = np.full(runs, size, np.uint64)
    for k in range(size):
        out += words[k : k + runs] * _PLACE[k]
    return mixed(out)


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words, sizes = word_hashes(texts)
    return [np.unique(ngram_hashes(own, n)) for own in np.split(words, np.cumsum(sizes)[:-1])]


def slices(texts: list[str | None], most: int = 1_000_000):
    """Ranges of texts with about so many characters in all, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
