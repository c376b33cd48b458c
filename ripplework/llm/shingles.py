"""Word shingles as sets of 64-bit hashes, for whole batches at once."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending. A-Z are lowered; words are runs of anything but space and U+0009..U+000D.

    A text of fewer than width words has its whole sequence as the one shingle, and none without words.
    """
    hashes = _Hashes()
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((hashes[w] for own in split for w in own), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    grams = np.zeros(0, np.uint64)
    if len(flat) >= width:
        n = len(flat) - width + 1
        grams = mix(flat[:n])
        for k in range(1, width):
            grams = mix(grams + flat[k : n + k])
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= width:
            out.append(np.unique(grams[end - size : end - width + 1]))
        elif size:
            whole = np.array([size], np.uint64)
            for at in range(end - size, end):
                whole = mix(whole + flat[at : at + 1])
            out.append(mix(whole ^ _M2))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
