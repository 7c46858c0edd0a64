"""Rolling hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd bases of the rolling hashes, and the multiplier that mixes a finished hash.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of any run of a text's words, from one pass over the words' hashes."""

    def __init__(self, hashes: np.ndarray, base: np.uint64 = BASES[0]) -> None:
        n = len(hashes)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.powers[:n], dtype=np.uint64, out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hashes of the runs of `length` words at the given starts, as unsigned 64-bit integers."""
        x = (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]
        x = (x ^ (x >> np.uint64(33))) * _MIX
        return x ^ (x >> np.uint64(29))
