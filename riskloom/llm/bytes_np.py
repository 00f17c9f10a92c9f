"""Vectorised hashes over the bytes of one text, for work inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(range(256)).lower()
_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n at least."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)], dtype=np.uint64)
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE)], dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of bytes that are no white space."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(WHITE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; equal spans have equal hashes."""
    powers, inverses = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_PLUS_ONE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """The hashes of the words of a text, A-Z folded to a-z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw.translate(_LOWER) if lower else raw, np.uint8)
    return hashes(data, *word_bounds(data))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every `width` consecutive words; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    width, short = min(width, len(words)), len(words) < width
    out = np.full(len(words) - width + 1, np.uint64(width if short else 0))
    for i in range(width):
        out = mix(out * _BASE + words[i : len(words) - width + 1 + i])
    return out


def span_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the word hashes from `first` up to `end` of each span, whatever the lengths."""
    powers, inverses = _grown(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return mix((sums[end] - sums[first]) * inverses[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
