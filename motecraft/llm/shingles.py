"""Word shingles of texts as hashes, and the SimHash of any hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

BITS, SEED = 64, 42
#: Stands for a null id, so that it comes last.
NO_ID = 2**63 - 1
_CHUNK = 1 << 15


def hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, in pieces."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last, digest = min(shingle, len(words)) - 1, xxhash.xxh64_intdigest
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - last].tolist()
    spans = list(zip(first, ends[last:].tolist(), strict=True))
    for k in range(0, len(spans), _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in spans[k : k + _CHUNK]], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(text, shingle)]))


def _stream(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent hashes made from one; the first is the hash itself."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(pieces: Iterable[np.ndarray], words: int = 1) -> np.ndarray:
    """`words` unsigned 64-bit numbers whose bits are set where over half the hashes have them; zero without any hash."""
    counts, n = np.zeros((words, BITS), np.int64), 0
    for h in pieces:
        for k in range(words):
            counts[k] += np.unpackbits(_stream(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64)[:, 0]
