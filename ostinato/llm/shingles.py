"""Word shingles of texts as sorted arrays of 64-bit hashes, and MinHash values of these."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)


def _word_bytes() -> np.ndarray:
    """ASCII digits and letters, and all bytes of other characters, are parts of words."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


_WORD = _word_bytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 to the 64."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64))) for x in (_MULTIPLIER, inverse))


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    word = _WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(12, int(len(raw)).bit_length())
    powers, inverses = _powers(size)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE_VALUES[raw] * powers[: len(raw)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of the lower-cased text, in order."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            while end < len(raw) and _WORD[raw[end]]:
                end += 1
        parts.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of so many words, ascending. A shorter text is one shingle, a text without words has none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    words = min(words, len(hashes))
    total = np.zeros(len(hashes) - words + 1, np.uint64)
    for k in range(words):
        total = total * np.uint64(0x2545F4914F6CDD1D) + hashes[k : len(hashes) - words + 1 + k]
    return np.unique(mix(total + np.uint64(words)))


@lru_cache(2)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(7).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return (made[0] << np.uint64(1) | np.uint64(1))[:, None], made[1][:, None]


def minhashes(values: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n hash functions over a set."""
    factor, shift = _functions(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(least, (values[None, at : at + 2048] * factor + shift).min(axis=1), out=least)
    return least
