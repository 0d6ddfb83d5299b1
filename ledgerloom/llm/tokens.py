"""Ids of whole texts by a tokenizer that drops white space, with each distinct chunk encoded once per worker."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ledgerloom.llm.common import spread_ranges

#: Entries and ids that a worker keeps before it starts anew; only memory depends on it.
CACHE_CHUNKS, CACHE_IDS = 900_000, 8_000_000
#: Chunks that are encoded as one text.
JOINED = 400


def chunk_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks between spaces and line feeds of every text, and where each text begins among them.

    The tokenizer drops white space and none of its rules looks across it (composition, lower case, special strings,
    pre-tokens), so a text's ids are those of its chunks in order. Other white space stays inside a chunk.
    """
    split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    return split.flatten(), offsets - offsets[0]


class ChunkEncoder:
    """Encodes columns of texts; keeps the ids of chunks it has seen."""

    def __init__(self, tokenizer: Tokenizer, chunks: Callable = chunk_lists, separator: str | None = "\n",
                 most_chunks: int = CACHE_CHUNKS):
        """``chunks`` cuts texts; chunks joined by ``separator`` must have their own ids one after the other."""
        self.tokenizer, self.chunks, self.separator, self.most_chunks = tokenizer, chunks, separator, most_chunks
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    @staticmethod
    def _grown(values: np.ndarray, needed: int) -> np.ndarray:
        if needed <= len(values):
            return values
        return np.concatenate((values, np.zeros(max(needed, 2 * len(values)) - len(values), values.dtype)))

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks one after the other and how many each has."""
        if self.separator is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for one in found for i in one), np.uint32, int(sizes.sum())), sizes
        # some hundred chunks in one text cost half as much as each alone; a token belongs where its first character is
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        texts = [self.separator.join(group) for group in groups]
        ids, sizes = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            begins = np.cumsum([0] + [len(chunk) + len(self.separator) for chunk in group[:-1]])
            firsts = np.fromiter((first for first, _ in e.offsets), np.int64, len(e))
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(begins, firsts, side="right") - 1, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, chunks: list[str]) -> np.ndarray:
        if len(self.place) > self.most_chunks or self.used > CACHE_IDS:
            self._reset()
        new = [chunk for chunk in chunks if chunk not in self.place]
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            found, sizes = self._fresh(part)
            first = len(self.place)
            self.ids = self._grown(self.ids, self.used + len(found))
            self.starts, self.sizes = self._grown(self.starts, first + len(part)), self._grown(self.sizes, first + len(part))
            self.ids[self.used : self.used + len(found)] = found
            self.starts[first : first + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[first : first + len(part)] = sizes
            self.place.update(zip(part, range(first, first + len(part))))
            self.used += len(found)
        return np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and the number of ids of each text; ``end_id`` follows every text."""
        chunks, begins = self.chunks(texts)
        coded = chunks.dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[places]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        lengths = np.diff(ends[begins])
        ids = self.ids[spread_ranges(self.starts[places], sizes)]
        if end_id is None:
            return ids, lengths
        return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


@functools.cache
def file_encoder(path: str) -> ChunkEncoder:
    """The encoder of a tokenizer file; tasks that follow each other in a worker share it."""
    return ChunkEncoder(Tokenizer.from_file(path))
