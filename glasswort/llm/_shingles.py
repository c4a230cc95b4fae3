"""Word shingles of many texts: 64-bit hashes by NumPy without a Python loop over words, and the words themselves.

A word's hash is the sum of random numbers, one for each byte and place
(tabulation hashing), mixed again: no pattern of letters makes two words
agree, as it does under sums of powers modulo 2^64.  Hashes choose
candidates; shingles_exact() is what confirms them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
_PIECE = 1 << 20
_U = np.uint64
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
#: A table entry for each byte at each of the first _PLACES places of a word.
_PLACES = 64
_table = np.random.default_rng(22).integers(0, 1 << 64, (_PLACES, 256), np.uint64).ravel()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def _pieces(docs: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(document, bytes): texts, long ones cut at blanks."""
    for i, data in docs:
        start = 0
        while len(data) - start > _PIECE:
            cut = next((c for c in range(start + _PIECE, start + _PIECE // 2, -1) if _blank[data[c]]), None)
            if cut is None:  # a word of half a million bytes: cut behind it
                cut = next((c for c in range(start + _PIECE, len(data)) if _blank[data[c]]), len(data))
            yield i, data[start:cut]
            start = cut
        yield i, data[start:]


def word_hashes(docs: list[bytes]) -> list[np.ndarray]:
    """Hashes of each document's words, A-Z lower-cased, in order."""
    found: list[list[np.ndarray]] = [[] for _ in docs]

    def flush(held: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"\n".join(x for _, x in held).lower(), np.uint8)
        word = ~_blank[data]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return
        place = np.flatnonzero(word)
        byte = data[place].astype(np.int64)
        lengths = end - start
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(byte)) - np.repeat(first, lengths)
        drawn = _table[np.minimum(place, _PLACES - 1) << 8 | byte]
        far = np.flatnonzero(place >= _PLACES)
        drawn[far] = mix(mix((place[far] << 8 | byte[far]).astype(_U)) + _U(0x9E3779B97F4A7C15))
        h = mix(np.add.reduceat(drawn, first) + lengths.astype(_U) * _U(0x165667B19E3779F9))
        upto = np.searchsorted(start, np.cumsum([len(x) + 1 for _, x in held]))
        for (i, _), a, b in zip(held, np.concatenate(([0], upto[:-1])), upto, strict=True):
            found[i].append(h[a:b])

    held, size = [], 0
    for piece in _pieces(enumerate(docs)):
        if size + len(piece[1]) > _PIECE and held:
            flush(held)
            held, size = [], 0
        held.append(piece)
        size += len(piece[1]) + 1
    if held:
        flush(held)
    return [np.concatenate(x) if x else np.zeros(0, _U) for x in found]


def shingle_set(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of fewer words, one of the whole sequence; of none, none."""
    if not len(words):
        return words
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, _U)
    for k in range(n):
        h = h * _U(0x27D4EB2F165667C5) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h))


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    return [shingle_set(w, width) for w in word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])]


def words_exact(text: str | None) -> list[bytes]:
    """The words themselves, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_exact(text: str | None, width: int = WORDS) -> frozenset[bytes]:
    """The set of shingle_set() as bytes: words hold no blank, so joined ones tell all apart."""
    words = words_exact(text)
    n = min(width, len(words))
    return frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()
