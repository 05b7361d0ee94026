"""Words, word hashes and five-word shingles of whole texts.

Words are what is left between the ASCII white space characters 0x20 and
0x09-0x0D after A-Z are lower-cased; on UTF-8 bytes ``lower`` and ``split`` do
exactly that. A word's hash is 64 bits of xxh3; a shingle's hash mixes the
hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

SHINGLE = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> hash; emptied when full, so its memory is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_kept: list = ["", None]


def kept(name: str, make: Callable[[], dict]) -> dict:
    """A worker's table of the kind that was used last; workers outlive stages, the tables of other stages don't."""
    if _kept[0] != name:
        _kept[:] = [name, None]  # the old one goes before the new one comes
        _kept[1] = make()
    return _kept[1]


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(kept("hashes", WordHashes).__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``width`` words, in order; fewer words make one run; none makes none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = hashes[: n - width + 1].copy()
        for k in range(1, width):
            out = out * _MULT + hashes[k : n - width + 1 + k]
        return mix(out)


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingles(word_hashes(words_of(text)), width))
