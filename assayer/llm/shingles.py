"""Hashed sets of word shingles, whole batches at a time.

Words are the runs of bytes other than space and 0x09 to 0x0D, with A-Z lowered.  A text's set holds the distinct
hashes of its five-word shingles; with fewer words the whole sequence is the only one; without words it is empty.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def constants(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(salt << 20)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = constants(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
_PLACE = constants(1 << 16, 2)
_IN_SHINGLE = constants(WORDS, 3)
_SHORT = constants(WORDS, 4)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and how many words stand before each text's end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inside = ends[:-1][ends[:-1] < len(data)]
    begins[inside] = solid[inside]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    with np.errstate(over="ignore"):
        value = _BYTE[data] * _PLACE[place & 0xFFFF]
        return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, cuts = word_hashes(data, ends)
    n = max(0, len(words) - WORDS + 1)
    with np.errstate(over="ignore"):
        full = np.zeros(n, np.uint64)
        for k in range(WORDS):
            full += words[k : k + n] * _IN_SHINGLE[k]
        full = mix(full)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= WORDS:
                out.append(np.unique(full[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _IN_SHINGLE[: b - a]).sum(keepdims=True) + _SHORT[b - a]))
            else:
                out.append(words[:0])
    return out
