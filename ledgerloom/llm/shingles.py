"""Sets of hashed word shingles of whole texts, from the hashes of their distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerloom.llm.words import cut, distinct, hashes, mixed


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, cut at ASCII white space) and each text's first word among them."""
    found = cut(texts, lower=True)
    return hashes(found.distinct)[found.codes], found.begins


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``words``-word shingles; of all its words if it has fewer, none if none."""
    hashes, begins = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        rolled = mixed(rolled + hashes[k : k + len(rolled)] * np.uint64(2 * k + 3))
    sets = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= words:
            sets.append(distinct(rolled[a : b - words + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                short = mixed(short * np.uint64(5) + h)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
