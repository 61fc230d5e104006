"""Word hashes in numpy, for the operators that run in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

CACHE = 200_000


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def factors(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread sums of products over all 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, k: int, by: np.ndarray) -> np.ndarray:
    """Hash of each k consecutive words, from their hashes."""
    out = h[: len(h) - k + 1] * by[0]
    for j in range(1, k):
        out += h[j : len(h) - k + 1 + j] * by[j]
    return mix(out)


def blank_words(text: bytes | None) -> list[bytes]:
    """Blank words of a UTF-8 text, A-Z lower-cased; bytes split at ASCII white space alone."""
    return text.lower().split() if text else []


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()
