"""Hashed word features of whole Arrow batches, computed on the UTF-8 buffer without a loop over texts."""

from __future__ import annotations

import numpy as np

from .common import U64, mix, prefix_hash, window_hash

#: ASCII letters and digits and every byte of a multi-byte character belong to words; A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, the text of each (no word spans two), and their 64-bit hashes."""
    inside = WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    end = np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    return start, end, owner, window_hash(prefix_hash(LOWER[data]), start, end)


def grams(owner: np.ndarray, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of word uni- and bigrams and of skip-grams over one and two words, in 2**bits slots."""
    texts, slots = [owner], [h >> U64(64 - bits)]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491), (3, 0x9FB21C65)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = mix((h[:-gap] * U64(3)) ^ (h[gap:] + U64(salt)))[same]
            texts.append(owner[gap:][same])
            slots.append(pair >> U64(64 - bits))
    return np.concatenate(texts), np.concatenate(slots).astype(np.int64)
