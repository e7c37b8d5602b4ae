"""Words of whole batches of texts as numpy arrays: spans, 64-bit hashes and n-gram hashes."""

from __future__ import annotations

import numpy as np

from .bytepair import WEIGHTS, eights, mix, span_hashes

#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(not_word: list[int]) -> np.ndarray:
    """For each byte, whether it is part of a word."""
    table = np.ones(256, bool)
    table[not_word] = False
    return table


#: Words that white space divides.
BY_SPACE = byte_class([0x20, *range(0x09, 0x0E)])
#: Words of letters, digits and anything beyond ASCII.
ALPHANUMERIC = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of words in lower-cased bytes, and the n + 1 offsets of texts into the words."""
    low = LOWER[data]
    n = len(low)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, whichever texts they are in; empty if there are fewer than k."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    h = hashes[:n] * WEIGHTS[0]
    for j in range(1, k):
        h += (hashes[j : n + j] ^ hashes[j : n + j] >> np.uint64(32)) * WEIGHTS[j]
    return mix(h)


def inside_text(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of the n runs of k words, whether it lies in one text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + k <= ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; of fewer words, the whole sequence; of none, nothing."""
    _, _, hashes, bounds = words(data, offsets, is_word)
    grams = gram_hashes(hashes, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(grams[a : b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(span_hashes(hashes[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


__all__ = ["ALPHANUMERIC", "BY_SPACE", "LOWER", "byte_class", "eights", "gram_hashes", "inside_text", "mix", "shingle_sets", "span_hashes", "words"]
