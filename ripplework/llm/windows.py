"""Hashes of all fixed-length byte windows of many texts at once, and runs of windows that share their least gram."""

from __future__ import annotations

import numpy as np

from .shingles import mix

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        filled = 1
        while filled < len(out):  # doubling
            step = min(filled, len(out) - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        _POWERS[name] = have = out
    return have[:n]


class Rolling:
    """Hash of any byte range of a buffer from two prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * _powers(_BASE, "up", n), out=self.sums[1:])
        self.down = _powers(_INVERSE, "down", n + 1)

    def fixed(self, length: int) -> np.ndarray:
        """The hash at each start of a range of this length."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(rolling: Rolling, begins: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with the same least gram, windows not crossing the texts [begin, end).

    Returns text number, first window, number of windows, the gram's hash and the hash of the bytes that the run's windows
    cover together with the gram's place in it. Equal windows have the same gram at the same place in them, whatever stands
    around them, so equal windows are in runs of the same gram; two windows of one run are never equal.
    """
    hashes = rolling.fixed(gram)
    if not len(hashes) or (ends - begins).max(initial=0) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    low = np.uint64((1 << 24) - 1)
    assert len(hashes) < 1 << 24, "buffers stay under 16 MB"
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    best = (sliding_least(packed, window - gram + 1) & low).astype(np.int64)  # leftmost of the least; at window starts
    long = ends - begins >= window
    n = np.where(long, ends - begins - window + 1, 0)
    text = np.repeat(np.arange(len(begins)), n)
    firsts = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(firsts, n) + np.repeat(begins, n)
    gram_at = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (gram_at[1:] != gram_at[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(at)))
    first = at[start]
    body = rolling.ranges(first, first + count - 1 + window)
    return text[start], first, count, hashes[gram_at[start]], mix(body + (gram_at[start] - first).astype(np.uint64))
