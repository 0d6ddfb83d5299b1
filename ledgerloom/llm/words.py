"""Words of whole texts as numbers: cut in the bytes of an Arrow column, each distinct word kept and hashed once."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ledgerloom.llm.common import buffers

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word of more bytes is hashed by itself.
LONG = 64
_ODD = np.random.Generator(np.random.PCG64(31)).integers(1 << 62, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Words(NamedTuple):
    """``codes``: the words in order, as places in ``distinct``; ``begins``: each text's first word, and the number of all."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    begins: np.ndarray
    codes: np.ndarray
    distinct: pa.Array


class Places(NamedTuple):
    """Where words lie in the bytes of all texts; ``begins``: each text's first word, and the number of all; ``inside``: bytes of words."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    begins: np.ndarray
    inside: np.ndarray


def places(texts: pa.Array, lower: bool, space: np.ndarray = SPACE) -> Places:
    """Places of words, cut at bytes of ``space``; a null has none."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~space[data]
    # a word never runs from one text into the next: the bytes on both sides of a border begin and end words
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[borders] = inside[borders]
    starts = np.flatnonzero(edge)
    edge[:] = inside
    edge[:-1] &= ~inside[1:]
    edge[borders - 1] = inside[borders - 1]
    lengths = np.flatnonzero(edge) + 1 - starts
    return Places(data, starts, lengths, np.searchsorted(starts, offsets), inside)


def encoded(found: Places) -> tuple[np.ndarray, pa.Array]:
    """The words in order, as places among the distinct ones, and these."""
    at = np.zeros(len(found.starts) + 1, np.int64)
    np.cumsum(found.lengths, out=at[1:])
    kept = found.data[found.inside]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found.starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def cut(texts: pa.Array, lower: bool, space: np.ndarray = SPACE) -> Words:
    """Words between bytes of ``space``; a null has none. About 20 bytes of memory per word and three per byte."""
    found = places(texts, lower, space)
    return Words(found.data, found.starts, found.lengths, found.begins, *encoded(found))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once; sorting is several times faster than the hashing of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(distinct: pa.Array, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; two families are independent. Longest words first, so a step has only those that go on."""
    data, offsets = buffers(distinct)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    found = mixed(sizes.astype(np.uint64) + _BASES[family])
    n_long = int(np.searchsorted(-sizes, -LONG))
    active = np.searchsorted(-sizes, -np.arange(1, LONG + 1), side="right")
    for k in range(LONG):
        a, b = n_long, int(active[k])
        if b <= a:
            break
        found[a:b] = (found[a:b] + _ODD[family][data[starts[a:b] + k]]) * _BASES[family]
        found[a:b] ^= found[a:b] >> np.uint64(29)
    for i in range(n_long):
        piece = data[starts[i] : starts[i] + sizes[i]].tobytes()
        found[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8, salt=bytes([family])).digest(), "little")
    result = np.empty_like(found)
    result[order] = mixed(found)
    return result
