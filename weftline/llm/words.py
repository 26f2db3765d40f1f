"""Words of a text as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_SEEN: dict[str, int] = {}
#: Words whose hashes are kept; the table is emptied beyond that, so it stays small whatever the corpus holds.
_KEPT = 500_000


def _missing(word: str) -> int:
    if len(_SEEN) > _KEPT:
        _SEEN.clear()
    got = _SEEN[word] = xxhash.xxh64_intdigest(word)
    return got


def word_hashes(words: list[str]) -> np.ndarray:
    get = _SEEN.get
    return np.fromiter((get(w) or _missing(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose high and low bits all depend on the input."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(3) + words[i : i + n] + np.uint64(i + 1))
    return out
