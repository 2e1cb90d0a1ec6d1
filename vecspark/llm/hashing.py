"""64-bit hashes of all words of many texts at once.

A word's hash is a sum over its bytes of a random number for the byte times a power for the place, brought back to the word's start. Sums over
all bytes of a stretch, and differences of those at the ends of words, give every word's hash without a loop over words.
"""

from __future__ import annotations

import numpy as np

#: Bytes taken at once, unless a word is longer.
STRETCH = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE[_SPACE] = 0
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64, for places up to ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(STRETCH + 1, n + 1)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
        del _powers[:-2]
    return _powers[0], _powers[1]


def _stretch(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of a stretch that ends with a space."""
    power, inverse = _power_tables(len(b))
    space = _SPACE[b]
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[b] * power[: len(b)], out=sums[1:])
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    h = (sums[end] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return start, h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and how many words each text has. Words are what bytes.split() gives, A-Z as a-z."""
    joined = b"\n".join(texts) + b"\n"
    whole = np.frombuffer(joined, np.uint8)
    firsts, hashes, at = [], [], 0
    while at < len(joined):
        end = min(at + STRETCH, len(joined))
        if end < len(joined):
            # back to the last space of the stretch, or on to the next one if a word fills it
            back = np.flatnonzero(_SPACE[whole[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while not _SPACE[whole[end - 1]]:
                    ahead = np.flatnonzero(_SPACE[whole[end : end + STRETCH]])
                    end = end + int(ahead[0]) + 1 if len(ahead) else min(end + STRETCH, len(joined))
        first, h = _stretch(whole[at:end])
        firsts.append(first + at)
        hashes.append(h)
        at = end
    first, h = np.concatenate(firsts), np.concatenate(hashes)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return h, np.diff(np.searchsorted(first, ends), prepend=0) if len(texts) else np.empty(0, np.int64)
