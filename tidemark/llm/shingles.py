"""Word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

WORDS_PER_SHINGLE = 5
_WORDS = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seeds: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """The number-th random value of each seed."""
    return mix(seeds + _GOLDEN * np.atleast_1d(np.asarray(number, np.uint64)))


_BYTES = stream(np.arange(256, dtype=np.uint64), 1)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_table(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)


def _ready(size: int) -> None:
    global _powers, _inverses
    if len(_powers) < size:
        size = 1 << size.bit_length()
        _powers, _inverses = _power_table(_BASE, size), _power_table(pow(_BASE, -1, 1 << 64), size)


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores of the lower-case text."""
    return _WORDS.findall(text.lower())


def shingle_hashes(text: str, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words, in order, with repetitions. A shorter text that has
    words is one shingle; a text without words has none.

    The hash of a run is the difference of two prefix values of a polynomial over all bytes, shifted
    back to the start, so it does not depend on where the run stands.
    """
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _ready(len(data) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * _powers[: len(data)], dtype=np.uint64)])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    span = min(size, len(words))
    starts, ends = starts[: len(starts) - span + 1], ends[span - 1 :]
    return mix((prefix[ends] - prefix[starts]) * _inverses[starts] + np.uint64(span))


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, ascending; how often each occurs)"""
    return np.unique(hashes, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: shared over combined number of shingles. Two texts without
    shingles are alike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    return shared / (total - shared)
