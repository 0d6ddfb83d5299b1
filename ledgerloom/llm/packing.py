"""Packing of documents into windows by multiway differencing.

A document's ids (with its end id) are cut at every full window; those pieces fill a window of their own. The rest is cut
at every quarter of a window, as small parts balance better, and packed in groups: partial partitions of a group into m windows are merged, always the two with the largest
spread, the largest sum of one with the smallest of the other, until one partition is left. If a window exceeds the
capacity, m rises by one and the group starts anew. A group holds ``GROUP_PIECES`` parts of one task and the rest of a document more at most, so
nothing is shuffled and memory does not depend on the input.

Null or empty text: its end id alone. Repeated rows: each is packed. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, text_columns, text_slices, tidy
from ledgerloom.llm.tokens import file_encoder

#: Ids in a window, end id of a document, parts packed together, bytes of text encoded at once.
WINDOW, END_ID, GROUP_PIECES, SLICE_BYTES = 2048, 1, 1024, 8 << 20

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in each of at most ``windows`` sets with near-equal sums.

    A partial partition is its non-zero sums in descending order, each with a tree of the indices in it; the windows
    it does not mention hold nothing yet. Once it mentions all, the smallest sum is taken off: only differences count.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, left = heapq.heappop(heap)
        _, _, right = heapq.heappop(heap)
        shared = len(left) + len(right) - windows
        if shared <= 0:
            merged = left + right
        else:
            # the windows that both fill: smallest sums of the left with smallest of the right, crosswise
            kept, other = len(left) - shared, len(right) - shared
            merged = left[:kept] + right[:other]
            merged += [(a[0] + b[0], (a[1], b[1])) for a, b in zip(left[kept:], reversed(right[other:]))]
        merged.sort(key=lambda entry: -entry[0])
        base = merged[-1][0] if len(merged) == windows else 0
        if base:
            merged = [(total - base, tree) for total, tree in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    return [_leaves(tree) for _, tree in heap[0][2]] if heap else []


def _leaves(tree) -> list[int]:
    found, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, tuple):
            open_ += node
        else:
            found.append(node)
    return found


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of indices whose sums fit ``capacity``; as few as differencing manages, from the least possible number up."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if all(sum(sizes[i] for i in one) <= capacity for one in found):
            return found
        windows += 1


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP_PIECES, keep_encoder: bool = True
) -> DataFrame:
    """A row per piece with its ids (little-endian unsigned 32-bit) and its place in a sequence.

    ``keep_encoder``: a worker keeps the encoder and the ids of chunks it has seen for its next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_ids = file_encoder(path), max(1, window // 4)
        next_sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*pieces), kinds)], names=names
            )

        names = [field.split()[0] for field in _PIECES.split(", ")]
        kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]

        def packed() -> list[tuple]:
            nonlocal next_sequence
            out = []
            for members in windows_of([piece[2] for piece in waiting], window):
                offset = 0
                for i in members:
                    out.append((*waiting[i], next_sequence, offset))
                    offset += waiting[i][2]
                next_sequence += 1
            waiting.clear()
            return out

        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids, lengths = encoder.encode(part.column(1), end_id)
                begins = np.cumsum(lengths) - lengths
                out: list[tuple] = []
                for doc_id, begin, total in zip(part.column(0).to_pylist(), begins.tolist(), lengths.tolist()):
                    full = total - total % window
                    for start in (*range(0, full, window), *range(full, total, part_ids)):
                        length = window if start < full else min(part_ids, total - start)
                        piece = (doc_id, start, length, ids[begin + start : begin + start + length].tobytes(), total)
                        if start < full:
                            out.append((*piece, next_sequence, 0))
                            next_sequence += 1
                        else:
                            waiting.append(piece)
                    if len(waiting) >= group:
                        out += packed()
                if out:
                    yield rows(out)
        if waiting:
            yield rows(packed())
        if not keep_encoder:
            del encoder
            file_encoder.cache_clear()

    return text_columns(docs).mapInArrow(tidy(run), _PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, tuple[Callable, str | None]] = {"op5_packing": (op5_packing, None)}
