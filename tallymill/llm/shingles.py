"""Word shingles of a text as 64-bit hashes, and their similarity sketches.

Worker code: numpy on one text at a time, free of Spark.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import xxhash
from pyspark import cloudpickle

# Workers get this module with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, COORDINATES, BAND = 5, 100, 4
REMEMBERED_WORDS = 1 << 20
_ODD = np.array(
    [xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(SHINGLE)], dtype=np.uint64
)
_SEEDS = np.array(
    [xxhash.xxh3_64_intdigest(b"round%d" % i) for i in range(2 * COORDINATES)], dtype=np.uint64
)
_EMPTY = np.uint64(2**64 - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31, _S32, _S8 = (np.uint64(n) for n in (27, 30, 31, 32, 8))


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix finaliser)."""
    z = (z ^ (z >> _S30)) * _M1
    z = (z ^ (z >> _S27)) * _M2
    return z ^ (z >> _S31)


class WordHashes(dict):
    """Remembers the hashes of the words seen; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; with fewer words, of all
    of them as one; none without a word. A-Z counts as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mixed((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    return np.unique(mixed(sum(h[i : i + n] * _ODD[i] for i in range(SHINGLE))))


def sketch(items: np.ndarray) -> np.ndarray:
    """One coordinate per bin, filled in rounds.

    In each of the first rounds every item is thrown into one bin under that
    round's hash; a bin keeps the least value of the first round that reached it.
    Bins still empty after as many rounds as there are bins get one more round
    each, with every item in that bin. So no coordinate stays empty, and two sets
    agree in a coordinate with the probability of their Jaccard similarity.
    The round stands in the top byte, which makes one minimum do for all rounds.
    """
    out = np.full(COORDINATES, _EMPTY)
    done = 0
    while done < COORDINATES:
        rounds = np.arange(done, min(COORDINATES, done + max(1, 1024 // len(items))), dtype=np.uint64)
        z = mixed(items[None, :] ^ _SEEDS[rounds.astype(np.int64), None])
        bins = ((z & np.uint64(0xFFFFFFFF)) * np.uint64(COORDINATES)) >> _S32
        value = (rounds[:, None] << np.uint64(56)) | (z >> _S8)
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        done += len(rounds)
        if not (out == _EMPTY).any():
            return out
    for b in np.flatnonzero(out == _EMPTY):
        i = COORDINATES + int(b)
        out[b] = np.uint64(i << 56) | (mixed(items ^ _SEEDS[i]) >> _S8).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One hash per band of consecutive coordinates, the band's number included."""
    rows = coordinates.reshape(-1, BAND)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _ODD[BAND]
    for i in range(BAND):
        key = mixed(key + rows[:, i] * _ODD[i])
    return key.view(np.int64)


def coarse(coordinates: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen to a 64-bit number, to estimate
    similarity cheaply."""
    bits = np.zeros(-(-COORDINATES // 16) * 16, np.uint64)
    bits[:COORDINATES] = mixed(coordinates) >> np.uint64(60)
    places = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (bits.reshape(-1, 16) << places).sum(axis=1, dtype=np.uint64).view(np.int64)


def signature(items: np.ndarray) -> bytes:
    """Equal for equal sets; 128 bits."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
