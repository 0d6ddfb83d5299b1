"""Substring dedup: words of 13-word windows that also start in a document with a smaller id are removed.

1. Texts are written once, in blocks of about ``BLOCK_BYTES``, to the shared folder; only blocks of the written manifest
   count, and every later pass reads the same blocks. Texts are never shuffled.
2. Every block makes its part of a count-min sketch: ``DEPTH`` rows of ``CELLS`` cells for each window of the table, so
   its width grows with the table. A block touches few cells, so it sends a row's touched cells, sorted and coded as
   differences, by range of cells. A range is merged by adding up: a cell that several blocks touched is counted as
   repeated. One bit per touched cell goes back to the block.
3. Windows all of whose cells are repeated may be repeated in another block; no repeated window is lost, as a count is
   never too small. Only those are sent on, as 96 bits of hash and the smallest id in the block, by range of hashes, and
   grouped exactly. One bit says whether another block has a smaller id. Repeats inside a block need no exchange.
4. Each block removes the covered words of its documents. What it needs for that was noted beside its questions: a bit per
   window for what the block itself decides, and for the others the number of the answer; no window is hashed again.

Ranges hold about ``PART`` windows at any size of the table, and a block sends each window once, so no passage, copy or
source makes a large group. Null or empty text: no words, nothing removed. A null id is neither smaller nor larger than
another: its document stays whole and removes nothing. Rows of one id remove nothing from each other; each is a result
row. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_folder, spread_ranges, table, text_columns, text_slices, tidy, written
from ledgerloom.llm.words import distinct, encoded, hashes, mixed, places

WORDS = 13
#: Text of a block, windows of a range, rows of the sketch, cells of a row for each window.
BLOCK_BYTES, PART, DEPTH, CELLS = 8 << 20, 1 << 21, 2, 8

_MANIFEST = "path string, n_words long"
_SENT = "path string, part int, n int, data binary"
_ASKED = f"{_SENT}, marks binary, ranks binary"
_MASK = "path string, part int, mask binary"
_KEPT = "doc_id long, n_words long, n_removed long, kept string"
_FACTORS = np.random.Generator(np.random.PCG64(13)).integers(1 << 62, 1 << 63, (2, 1024), dtype=np.uint64) | np.uint64(1)
_SALTS = np.random.Generator(np.random.PCG64(7)).integers(1 << 62, 1 << 63, 16, dtype=np.uint64)


# --- blocks of texts


def write_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """The manifest of written blocks: path and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get(), 0
        target, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                name = f"block-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}"
                with target.open_output_stream(f"{root}/{name}") as out:
                    with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                        sink.write_batch(part)
                seq += 1
                found = places(part.column(1), lower=False)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(found.starts)])], names=["path", "n_words"])

    return written(docs.mapInArrow(run, _MANIFEST), "passage-blocks")


def read_block(path: str) -> pa.Table:
    source, name = fs.FileSystem.from_uri(path)
    with source.open_input_stream(name) as file, pa.ipc.open_stream(file) as stream:
        return stream.read_all().combine_chunks()


class Block:
    """Words of a written block, and the first words of the windows of its documents in the order of the texts."""

    def __init__(self, path: str, words: int):
        rows = read_block(path)
        ids, texts = rows.column(0).chunk(0), rows.column(1).chunk(0)
        self.doc_ids = ids
        self.words = places(texts, lower=False)
        begins = self.words.begins
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.per_doc = np.where(known, np.maximum(np.diff(begins) - words + 1, 0), 0)
        self.starts = spread_ranges(begins[:-1], self.per_doc)

    def rolled(self, words: int, families: int) -> list[np.ndarray]:
        """Hashes of all windows, by family."""
        codes, spelled = encoded(self.words)
        found = []
        for family in range(families):
            each = hashes(spelled, family)[codes]
            total = np.zeros(max(0, len(each) - words + 1), np.uint64)
            step = np.empty_like(total)
            for k in range(words):
                total += np.multiply(each[k : k + len(total)], _FACTORS[family][k], out=step)
            found.append(mixed(total[self.starts]))
        return found


class Windows:
    """Windows of a block by distinct sequence: hashes in order, smallest id, and the place of each window among the distinct."""

    def __init__(self, block: Block, words: int):
        one, two = block.rolled(words, 2)
        order = np.argsort(one)
        same = one[order][1:] == one[order][:-1]
        if np.any(same & (two[order][1:] != two[order][:-1])):
            order = np.lexsort((two, one))  # one hash of two sequences
        one, two = one[order], two[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(fresh)
        self.one, self.two = one[first], two[first]
        self.docs = np.repeat(block.doc_ids.fill_null(0).to_numpy(), block.per_doc)
        self.least = np.minimum.reduceat(self.docs[order], first) if len(first) else np.zeros(0, np.int64)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.cumsum(fresh) - 1


def cells(one: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of every window in a row of the sketch; those of the first row are in the order of the hashes."""
    return (mixed(one ^ _SALTS[row]) if row else one) >> np.uint64(64 - bits)


# --- numbers on their way


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte of all values, so that equal high bytes vanish."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        found.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += n * size
    return found


def sent(path: str, values: np.ndarray, bits: int, ranges: int, first_part: int, *more: np.ndarray) -> pa.RecordBatch:
    """Sorted ``values`` of ``bits`` bits and ``more`` columns as a row per range of values; empty ranges send nothing."""
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)
    at = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    rows = []
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            steps = np.diff(values[a:b], prepend=np.uint64(0))
            rows.append((path, first_part + k, b - a, pack(steps, *(m[a:b] for m in more))))
    return batch(rows, _SENT)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def bits_of(masks: list | None, first_part: int, last_part: int, n: int) -> np.ndarray:
    """The bits of a block's ranges in order; none if the block had nothing to send."""
    chosen = sorted((m["part"], m["mask"]) for m in masks or () if first_part <= m["part"] < last_part)
    found = [np.unpackbits(np.frombuffer(mask[4:], np.uint8), count=int.from_bytes(mask[:4], "little")) for _, mask in chosen]
    bits = np.concatenate(found).astype(bool) if found else np.zeros(0, bool)
    if len(bits) != n:
        raise ValueError("a block and its replies do not fit together")
    return bits


def mask_row(path: str, part: int, bits: np.ndarray) -> tuple:
    return path, part, len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes()


# --- merging a range


def repeated_cells(rows: pa.Table) -> pa.Table:
    """Per block a bit for each cell it sent: whether other blocks touched it too."""
    paths, parts, counts, data = (rows.column(k).to_pylist() for k in range(4))
    cells = [np.cumsum(unpack(d, n, "<u8")[0]) for d, n in zip(data, counts)]
    together = np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.uint64)
    twice = together[1:][together[1:] == together[:-1]]
    return pa.Table.from_batches([batch([mask_row(p, k, _held(twice, c)) for p, k, c in zip(paths, parts, cells)], _MASK)])


def _held(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(asked), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)] == asked


def smaller_elsewhere(rows: pa.Table) -> pa.Table:
    """Per block a bit for each window it sent: whether another block has it in a document with a smaller id."""
    paths, parts, counts, data = (rows.column(k).to_pylist() for k in range(4))
    columns = [unpack(d, n, "<u8", "<u4", "<i8") for d, n in zip(data, counts)]
    one = np.concatenate([np.cumsum(c[0]) for c in columns])
    two, least = (np.concatenate([c[k] for c in columns]) for k in (1, 2))
    order = np.lexsort((two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = np.flatnonzero(fresh)
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order))))
    bits = np.split(smallest < least, np.cumsum(counts)[:-1])
    return pa.Table.from_batches([batch([mask_row(p, k, b) for p, k, b in zip(paths, parts, bits)], _MASK)])


# --- marks of a block's windows, in the order of its texts


def marks(found: Windows, some: np.ndarray) -> tuple[bytes, bytes]:
    """A bit for each window that a smaller id of the block removes, a bit for each that an answer decides, and which of ``some`` those are."""
    gone = found.least[found.place] < found.docs
    rank = np.full(len(found.one), -1, np.int32)
    rank[some] = np.arange(len(some), dtype=np.int32)
    ranks = rank[found.place]
    undecided = (ranks >= 0) & ~gone
    return pack(np.packbits(gone), np.packbits(undecided)), pack(ranks[undecided].astype("<u4"))


def removed(n: int, marked: bytes, ranks: bytes, elsewhere: np.ndarray) -> np.ndarray:
    """Which of a block's ``n`` windows go, by its marks and the answers to what it asked."""
    gone, undecided = (np.unpackbits(bits, count=n).astype(bool) for bits in unpack(marked, -(-n // 8), "u1", "u1"))
    gone[undecided] = elsewhere[unpack(ranks, int(undecided.sum()), "<u4")[0]]
    return gone


# --- the passes


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; ``kept``: the words that stay, joined by one space."""
    if not 1 <= words <= _FACTORS.shape[1]:
        raise ValueError(f"windows of 1 to {_FACTORS.shape[1]} words")
    spark = docs.sparkSession
    manifest = write_blocks(text_columns(docs), new_folder(spark, "passages"))
    total = manifest.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()
    ranges = max(1, -(-total["n"] // PART))
    bits = max(16, (max(1, total["n"]) * CELLS - 1).bit_length())
    tasks = max(1, min(total["blocks"], 16 * spark.sparkContext.defaultParallelism))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column(0).to_pylist():
                (one,) = Block(path, words).rolled(words, 1)
                for row in range(DEPTH):
                    yield sent(path, distinct(cells(one, row, bits)), bits, ranges, row * ranges)

    replies = manifest.repartition(tasks).mapInArrow(tidy(touched), _SENT).groupBy("part").applyInArrow(repeated_cells, _MASK)
    replies = written(replies, "passage-cells")

    def likely(one: np.ndarray, masks: list | None) -> np.ndarray:
        """Which distinct windows, by sorted hashes, are estimated to be in other blocks too: their places."""
        some = np.arange(len(one))
        for row in range(DEPTH):
            touching = cells(one, row, bits)
            own = distinct(touching)
            mask = bits_of(masks, row * ranges, (row + 1) * ranges, len(own))
            if row:
                some = some[mask[np.searchsorted(own, touching[some])]]
            else:  # sorted: a cell's place is the number of changes before it
                some = some[mask[np.cumsum(np.diff(touching, prepend=touching[:1]) != 0)]]
        return some

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, masks in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                block = Block(path, words)
                found = Windows(block, words)
                some = likely(found.one, masks)
                questions = sent(
                    path, found.one[some], 64, ranges, 0, (found.two[some] >> np.uint64(32)).astype("<u4"), found.least[some].astype("<i8")
                )
                none = pa.nulls(questions.num_rows, pa.binary())
                yield questions.append_column("marks", none).append_column("ranks", none)
                yield batch([(path, None, len(some), None, *marks(found, some))], _ASKED)

    by_block = replies.groupBy("path").agg(F.collect_list(F.struct("part", "mask")).alias("cells"))
    with_cells = manifest.join(by_block, "path", "left").select("path", "cells")
    questions = written(with_cells.repartition(tasks).mapInArrow(tidy(asked), _ASKED), "passage-questions")
    answers = questions.where("part is not null").select("path", "part", "n", "data").groupBy("part").applyInArrow(smaller_elsewhere, _MASK)
    answers = answers.groupBy("path").agg(F.collect_list(F.struct("part", "mask")).alias("windows"))
    blocks = questions.where("part is null").select("path", "n", "marks", "ranks")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, n, marked, ranks, windows in zip(*(rows.column(k).to_pylist() for k in range(5))):
                block = Block(path, words)
                yield from kept_texts(block, removed(len(block.starts), marked, ranks, bits_of(windows, 0, ranges, n)), words)

    return blocks.join(answers, "path", "left").repartition(tasks).mapInArrow(tidy(finished), _KEPT)


def kept_texts(block: Windows, gone: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    data, starts, lengths, begins, _ = block.words
    steps = np.zeros(len(starts) + words + 1, np.int64)
    np.add.at(steps, block.starts[gone], 1)
    np.add.at(steps, block.starts[gone] + words, -1)
    stays = np.cumsum(steps)[: len(starts)] == 0
    n_kept = np.concatenate(([0], np.cumsum(stays)))[begins]
    begin, size = starts[stays], lengths[stays] + 1
    padded = np.append(data, np.uint8(0x20))
    text = padded[spread_ranges(begin, size)]
    ends = np.cumsum(size)
    text[ends - 1] = 0x20  # one space after every word
    edges = np.concatenate(([0], ends))[n_kept]
    for first in range(0, len(block.doc_ids), 2000):
        some = slice(first, first + 2000)
        spans = zip(edges[:-1][some].tolist(), edges[1:][some].tolist())
        kept = [text[a : max(a, b - 1)].tobytes() for a, b in spans]
        yield pa.RecordBatch.from_arrays(
            [
                block.doc_ids[some], pa.array(np.diff(begins)[some]), pa.array((np.diff(begins) - np.diff(n_kept))[some]),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def op13_passages(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, tuple[Callable, str | None]] = {"op13_passages": (op13_passages, None)}
