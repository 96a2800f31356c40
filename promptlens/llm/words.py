"""Words and word shingles of many texts at once, on their UTF-8 bytes.

A word is a run of ASCII letters and digits and of bytes of any character
beyond ASCII; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

from promptlens.llm.common import Rolling, mix

#: Words in a shingle.
SHINGLE = 5

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; rows are ``data[at[i]:at[i + 1]]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    edge = inside[1:] != inside[:-1]
    cuts = np.unique(at)  # a word that runs over the end of a row is two words
    cut = cuts[inside[cuts] & inside[np.minimum(cuts + 1, len(data) + 1)]]
    bounds = np.flatnonzero(edge)
    start, end = bounds[0::2], bounds[1::2]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(at, start, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of every word, with A-Z lowered."""
    start, end, row = words(data, at)
    return Rolling(lowered(data)).between(start, end), start, end, row


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words that stand together (rows are not regarded)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n])
    return h


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row.

    A text of fewer than k words has one shingle, all its words; a text
    without words has none.
    """
    word, _, _, row = word_hashes(data, at)
    count = np.bincount(row, minlength=len(at) - 1)[: len(at) - 1]
    first = np.concatenate([[0], np.cumsum(count)])
    h = gram_hashes(word, k)
    out = []
    for i, n in enumerate(count):
        if n >= k:
            out.append(np.unique(h[first[i] : first[i + 1] - k + 1]))
        elif n:
            out.append(gram_hashes(word[first[i] : first[i + 1]], int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
