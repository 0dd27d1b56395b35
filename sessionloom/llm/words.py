"""Words and their 64-bit hashes, alike in every process."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers that tell the places of a shingle apart.
_PLACES = np.array([xxhash.xxh64_intdigest(b"place", seed=k) | 1 for k in range(8)], dtype=np.uint64)
_LIMIT = 300_000
#: What other operators remember in a worker; one operator's memory goes when another begins.
others: list[dict] = []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) - (1 << 63)
        self[word] = value
        return value


_hashes = _Hashes()


def forget() -> None:
    """Drop the remembered hashes."""
    _hashes.clear()


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


def hashed(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers a bounded number of them."""
    for held in others:
        held.clear()
    if len(_hashes) > _LIMIT:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, found), np.int64, len(found)).view(np.uint64)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts: the hashes of their distinct words, their words as places among these, and how many words each has.

    Words and hashes are those of :func:`words` and :func:`hashed`; each distinct word is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)) + np.uint64(1 << 63)
    places, lengths = flat.indices.to_numpy(), split.value_lengths().to_numpy().astype(np.int64)
    if b"" in names:  # stands before white space that begins a text and after white space that ends one
        none = names.index(b"")
        full = places != none
        before = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(lengths)
        lengths = before[ends] - before[ends - lengths]
        places = places[full]
        places, h = places - (places > none), np.delete(h, none)
    return h, places, lengths


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _PLACES[0]
    for k in range(1, size):
        total += h[k : k + n] * _PLACES[k]
    return mix(total)


def joined(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words: :func:`grams` of two, for words that do not lie in a row."""
    return mix(before * _PLACES[0] + h * _PLACES[1])


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted set of a text's shingles; with fewer words, the whole sequence as one."""
    h = hashed(words(text))
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(grams(h, min(size, len(h))) + np.uint64(len(h) if len(h) < size else 0))
