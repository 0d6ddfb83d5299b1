"""Token files: ids of documents in ascending doc_id order, coded by ``rans`` with one frequency table per file.

Documents are range-partitioned and sorted by id. Each task encodes its texts and writes files of about ``FILE_IDS``
ids to the given shared folder under names of its own attempt; only files named in the returned manifest count, so a
repeated or lost task leaves nothing that is read. A file is

    magic, length of header, header (JSON: counts, lanes, block index), compressed sections: symbols, frequencies,
    document ids, null flags, document lengths, checkpoint positions and states; then the words of all blocks.

Null text: empty, the end id alone. Null ids come first. Repeated rows: each is written. Empty table: no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import rans
from ledgerloom.llm.common import new_folder, table, text_columns, text_slices, written
from ledgerloom.llm.tokens import file_encoder

MAGIC = b"LLTOKEN1"
#: Ids in a file before the next begins, end id of a document, bytes of text encoded at once.
FILE_IDS, END_ID, SLICE_BYTES = 1 << 22, 2, 4 << 20

_MANIFEST = "shard long, seq long, path string, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids binary"
_SECTIONS = (("symbols", "<u4"), ("freqs", "<u4"), ("doc_ids", "<i8"), ("nulls", "u1"), ("lengths", "<u8"),
             ("positions", "<u4"), ("states", "<u8"))


def to_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, freqs, bits = rans.frequencies(ids)
    blocks = rans.encode_blocks(ids, symbols, freqs, bits)
    arrays = {
        "symbols": symbols, "freqs": freqs, "doc_ids": np.array([i or 0 for i in doc_ids], np.int64),
        "nulls": np.array([i is None for i in doc_ids]), "lengths": lengths,
        "positions": np.concatenate([b["positions"] for b in blocks]) if blocks else np.zeros(0),
        "states": np.concatenate([b["states"] for b in blocks]).ravel() if blocks else np.zeros(0),
    }
    sections = [zlib.compress(arrays[name].astype(kind).tobytes(), 1) for name, kind in _SECTIONS]
    header = json.dumps({
        "bits": bits, "lanes": rans.LANES, "block_ids": rans.BLOCK_IDS, "check_steps": rans.CHECK_STEPS,
        "sections": [len(s) for s in sections], "crc": [zlib.crc32(s) for s in sections],
        "blocks": [[b["n_ids"], len(b["words"]), b["words_crc"], b["ids_crc"]] for b in blocks],
    }).encode()
    words = [b["words"].tobytes() for b in blocks]
    return b"".join([MAGIC, struct.pack("<II", len(header), zlib.crc32(header)), header, *sections, *words])


def from_bytes(data: bytes, only: slice = slice(None)) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and the ids of all blocks, or of the blocks ``only``."""
    size, crc = struct.unpack_from("<II", data, len(MAGIC))
    at = len(MAGIC) + 8
    header_bytes = data[at : at + size]
    if data[: len(MAGIC)] != MAGIC or zlib.crc32(header_bytes) != crc:
        raise ValueError("not a token file, or its header is damaged")
    header = json.loads(header_bytes)
    if (header["lanes"], header["block_ids"], header["check_steps"]) != (rans.LANES, rans.BLOCK_IDS, rans.CHECK_STEPS):
        raise ValueError("a token file of another block layout")
    at += size
    found = {}
    for (name, kind), length, crc in zip(_SECTIONS, header["sections"], header["crc"]):
        if zlib.crc32(data[at : at + length]) != crc:
            raise ValueError(f"section {name} is damaged")
        found[name] = np.frombuffer(zlib.decompress(data[at : at + length]), kind)
        at += length
    stretches = rans.BLOCK_IDS // rans.LANES // rans.CHECK_STEPS
    blocks = []
    for k, (n_ids, n_words, words_crc, ids_crc) in enumerate(header["blocks"]):
        blocks.append({
            "n_ids": n_ids, "words": np.frombuffer(data, "<u4", n_words, at), "words_crc": words_crc, "ids_crc": ids_crc,
            "positions": found["positions"][k * stretches : (k + 1) * stretches],
            "states": found["states"].reshape(-1, rans.LANES)[k * stretches : (k + 1) * stretches],
        })
        at += 4 * n_words
    ids = rans.decode_blocks(blocks[only], found["symbols"], found["freqs"], header["bits"])
    doc_ids = [None if null else i for i, null in zip(found["doc_ids"].tolist(), found["nulls"].tolist())]
    return doc_ids, found["lengths"].astype(np.int64), ids


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """The manifest of the written files: shard and sequence number give their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = file_encoder(path)
        target, root = fs.FileSystem.from_uri(folder)
        doc_ids, lengths, ids, seq = [], [], [], 0

        def put() -> pa.RecordBatch:
            nonlocal seq
            all_ids, all_lengths = np.concatenate(ids), np.concatenate(lengths)
            name = f"part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.tok"
            with target.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(doc_ids, all_lengths, all_ids))
            row = [[task.partitionId()], [seq], [f"{folder}/{name}"], [len(doc_ids)], [len(all_ids)]]
            seq += 1
            for one in (doc_ids, lengths, ids):
                one.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=[f.split()[0] for f in _MANIFEST.split(", ")])

        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                new_ids, new_lengths = encoder.encode(part.column(1), end_id)
                doc_ids += part.column(0).to_pylist()
                ids.append(new_ids)
                lengths.append(new_lengths)
                if sum(map(len, ids)) >= FILE_IDS:
                    yield put()
        if doc_ids:
            yield put()

    ordered = text_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """A row per document with its ids; ``start`` counts the ids of all documents before it.

    The driver sees one total per shard, that is per task of the writing stage.
    """
    spark = manifest.sparkSession
    totals = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).orderBy("shard").collect()
    starts, before = [], 0
    for row in totals:
        starts.append((row["shard"], before))
        before += row["n"]
    shard_starts = spark.createDataFrame(starts, "start_shard long, shard_start long")
    earlier = manifest.select("shard", F.col("seq").alias("other"), F.col("n_ids").alias("n")).groupBy("shard").agg(
        F.collect_list(F.struct("other", "n")).alias("files")  # the files of one task
    )
    located = (
        manifest.join(earlier, "shard")
        .join(shard_starts, F.col("shard") == F.col("start_shard"))
        .select("path", (F.col("shard_start") + F.expr(
            "aggregate(files, 0L, (acc, f) -> acc + if(f.other < seq, f.n, 0L))")).alias("file_start"))
    )
    n_files = sum(row["files"] for row in totals)
    tasks = max(1, min(n_files, 16 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file_start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as file:
                    doc_ids, lengths, ids = from_bytes(file.read())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                for first in range(0, len(doc_ids), 2000):
                    some = slice(first, first + 2000)
                    spans = zip((ends - lengths)[some].tolist(), ends[some].tolist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[some], pa.int64()), pa.array((file_start + ends - lengths)[some]),
                            pa.array(lengths[some]), pa.array([raw[4 * a : 4 * b] for a, b in spans], pa.binary()),
                        ],
                        names=[f.split()[0] for f in _DOCS.split(", ")],
                    )

    return located.repartition(tasks).mapInArrow(run, _DOCS)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    manifest = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, tuple[Callable, str | None]] = {"op6_token_files": (op6_token_files, None)}
