"""Words and word hashes shared by the document operators (runs inside Arrow tasks).

A word is a maximal run outside U+0020 and U+0009-U+000D, the six bytes ``bytes.split`` separates on.
Hashes are xxHash64 of the UTF-8 bytes, so every executor and every rerun agrees.
"""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 500_000
CACHE_WORD_BYTES = 128


class _WordHashes(dict):
    """word bytes -> 64-bit hash; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_CACHES: dict[int, _WordHashes] = {}


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    cache = _CACHES.setdefault(seed, _WordHashes(seed))
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (murmur3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``size`` word hashes (empty if there are fewer)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Masks that keep the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SEEDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, two independent 64-bit hashes of every word, text after text), without a Python
    object per word: words are mixed in by eight bytes at a time, those over CACHE_WORD_BYTES by xxHash64."""
    joined = b" " + b" ".join(texts) + b" " * 8
    blank = _BLANK[np.frombuffer(joined, dtype=np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, length = edges[0::2], edges[1::2] - edges[0::2]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.diff(np.searchsorted(starts, ends_of_texts, side="right"), prepend=0)
    eights = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
    lane = eights[starts] & _FIRST[np.minimum(length, 8)]
    hashes = [mix64((lane ^ seed) + length.astype(np.uint64) * seed) for seed in _SEEDS]
    at, more = np.flatnonzero((length > 8) & (length <= CACHE_WORD_BYTES)), 8
    while len(at):
        lane = eights[starts[at] + more] & _FIRST[np.minimum(length[at] - more, 8)]
        for h, seed in zip(hashes, _SEEDS):
            h[at] = mix64((h[at] ^ lane) * seed)
        more += 8
        at = at[length[at] > more]
    for i in np.flatnonzero(length > CACHE_WORD_BYTES):
        word = joined[starts[i]:starts[i] + length[i]]
        for seed, h in enumerate(hashes):
            h[i] = xxhash.xxh64_intdigest(word, seed)
    return sizes, *hashes


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """As ``window_hashes``, other values: two runs of half the size (overlapping, if ``size`` is no power of two) make
    one, so the steps grow with the logarithm of the size."""
    out, length = h, 1
    while length < size:
        step = min(length, size - length)
        n = max(0, len(out) - step)
        left = out[:n] * np.uint64(0x9E3779B97F4A7C15)
        left ^= left >> np.uint64(32)
        left += out[step:]
        left *= np.uint64(0xC4CEB9FE1A85EC53)
        left ^= left >> np.uint64(29)
        out, length = left, length + step
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs that Spark stores."""
    return x.view(np.int64)
