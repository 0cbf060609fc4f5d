"""Distinct word shingles of whole texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 4
#: Lower-cases A-Z and turns space, tab, line feed, vertical tab, form feed and carriage return into a space.
_BYTES = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text): a sum of bytes by coefficients of their place in the word."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_BYTES) for t in texts]
    joined = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(p) + 1 for p in parts])
    solid = joined != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_texts))))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    place = np.arange(len(joined)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(joined)])))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(joined))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.concatenate((starts, [len(joined)]))))
    terms = joined.astype(np.uint64) + np.uint64(1)
    terms *= _coefficients(int((ends - starts).max()) + 1)[np.where(solid, place, 0)]
    terms[~solid] = 0
    sums = np.add.reduceat(terms, starts)
    return mixed(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``words``-word shingles of each text; a shorter text is one shingle, a text without words none."""
    hashes, counts = word_hashes(texts)
    c = _coefficients(words + 1)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(words):
        rolled += hashes[i : i + n] * c[i]
    rolled = mixed(rolled)
    out, at = [], 0
    for k in counts:
        if k >= words:
            s = np.sort(rolled[at : at + k - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif k:
            short = (hashes[at : at + k] * c[:k]).sum(dtype=np.uint64, keepdims=True) + c[words : words + 1] * np.uint64(k)
            out.append(mixed(short))
        else:
            out.append(np.empty(0, np.uint64))
        at += k
    return out
