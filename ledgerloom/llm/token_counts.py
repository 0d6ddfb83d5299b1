"""Token counts of whole texts: pieces of a distinct pre-token are counted once and joined to frequencies.

Pre-tokens are what the tokenizer's normaliser and splitter make of a text, or a special string. ``frequencies`` turns
blocks of documents into the block's distinct pre-tokens and, per document, how often it holds each; ``piece_counts``
counts the pieces of a pre-token once; ``token_counts`` joins the counts back to the blocks and sums. No ids are kept
or moved. A block's chunks between spaces are split once each, as white space never joins pre-tokens.

Null text: empty, 0 tokens. Repeated rows: a result row each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import buffers, spread_ranges, table, text_columns, text_slices, written
from ledgerloom.llm.tokens import chunk_lists

#: Bytes of text in a block (a longer document is a block of its own) and bits for a place inside a block.
BLOCK_BYTES, PLACE_BITS = 16 << 20, 31

_BLOCKS = (
    "part int, block long, doc_id array<long>, n_bytes array<long>, words array<string>, n_words array<int>, codes binary, "
    "counts binary"
)


class PreTokens:
    """Pre-tokens of chunks, and the number of pieces of a pre-token."""

    def __init__(self, path: str):
        whole = Tokenizer.from_file(path)
        self.normalise = whole.normalizer.normalize_str
        definition = json.loads(whole.to_str())
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in definition["added_tokens"]) or r"(?!)")
        split = definition["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # without normaliser and splitter the library takes a pre-token as it is
        definition["normalizer"], definition["pre_tokenizer"]["pretokenizers"][0:1] = None, []
        self.model = Tokenizer.from_str(json.dumps(definition))

    def of_chunk(self, chunk: str) -> list[str]:
        if not self.special.search(chunk):
            return self.pattern.findall(self.normalise(chunk))
        found, at = [], 0
        for match in self.special.finditer(chunk):
            found += self.pattern.findall(self.normalise(chunk[at : match.start()])) + [match.group()]
            at = match.end()
        return found + self.pattern.findall(self.normalise(chunk[at:]))

    def n_pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(words, add_special_tokens=False)]


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """A row per block: documents, distinct pre-tokens in order, and packed (pre-token, count) pairs per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seq = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=9)
        split = PreTokens(path)
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                chunks, begins = chunk_lists(part.column(1))
                coded = chunks.dictionary_encode()
                # numbers in order of appearance first: no list of lists of words is held
                code: dict[str, int] = {}
                flat, sizes = array("i"), array("i")
                for chunk in coded.dictionary.to_pylist():
                    found = [code.setdefault(word, len(code)) for word in split.of_chunk(chunk)]
                    flat.extend(found)
                    sizes.append(len(found))
                words = sorted(code)
                rank = np.empty(len(words), np.int64)
                rank[np.fromiter(map(code.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
                flat, sizes = rank[np.frombuffer(flat, np.int32)], np.frombuffer(sizes, np.int32).astype(np.int64)
                at = coded.indices.to_numpy(zero_copy_only=False)
                del chunks, coded, code, rank
                codes = flat[spread_ranges((np.cumsum(sizes) - sizes)[at], sizes[at])]
                ends = np.concatenate(([0], np.cumsum(sizes[at])))
                codes |= np.repeat(np.arange(part.num_rows), np.diff(ends[begins])) << PLACE_BITS
                codes.sort()
                first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else codes
                counts, pairs = np.diff(np.append(first, len(codes))), codes[first]
                n_words = np.bincount(pairs >> PLACE_BITS, minlength=part.num_rows)
                _, offsets = buffers(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition], pa.int32()),
                        pa.array([seq], pa.int64()),
                        pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                        pa.array([words], pa.list_(pa.string())),
                        pa.array([n_words.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([pack.compress((pairs & ((1 << PLACE_BITS) - 1)).astype(np.uint32).tobytes())]),
                        pa.array([pack.compress(counts.astype(np.uint32).tobytes())]),
                    ],
                    names=[field.split()[0] for field in _BLOCKS.split(", ")],
                )
                seq += 1
                del part, codes, flat, sizes, at, pairs, counts, words
                pa.default_memory_pool().release_unused()

    return text_columns(docs).mapInArrow(run, _BLOCKS)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(part, place, pieces) for (word, part, place): rows are dealt and sorted by word, so each distinct word is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens = PreTokens(path)
        last_word, last_count = None, 0
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            asked = distinct[1:] if distinct and distinct[0] == last_word else distinct
            counts = [last_count] * (len(distinct) - len(asked)) + pre_tokens.n_pieces(asked)
            last_word, last_count = distinct[-1], counts[-1]
            pieces = np.array(counts, np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(pieces)], names=["part", "place", "pieces"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "part int, place long, pieces int")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row by the tokenizer file ``path``."""
    blocks = written(frequencies(docs, path), "frequencies")
    # a block is named by its partition and its number there
    words = blocks.select("part", "block", F.posexplode("words").alias("code", "word")).select(
        "word", "part", (F.shiftleft("block", PLACE_BITS) + F.col("code")).alias("place")
    )
    found = (
        piece_counts(words, path)
        .groupBy(F.col("part").alias("found_part"), F.shiftright("place", PLACE_BITS).alias("found_block"))
        .agg(F.collect_list(F.struct("place", "pieces")).alias("found"))
        .select("found_part", "found_block", F.col("found.place").alias("places"), F.col("found.pieces").alias("pieces"))
    )
    joined = blocks.join(found, (F.col("part") == F.col("found_part")) & (F.col("block") == F.col("found_block")), "left").select(
        "doc_id", "n_bytes", "n_words", "codes", "counts", "places", "pieces"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, n_bytes, n_words, codes, counts, places, pieces = (batch.column(k)[i] for k in range(7))
                if places.is_valid:
                    places, pieces = places.values.to_numpy(), pieces.values.to_numpy()
                else:  # a block of documents without pre-tokens
                    places = pieces = np.zeros(0, np.int64)
                by_code = np.zeros(len(places), np.int64)
                by_code[places & ((1 << PLACE_BITS) - 1)] = pieces
                codes = np.frombuffer(unpack.decompress(codes.as_py()), np.uint32)
                counts = np.frombuffer(unpack.decompress(counts.as_py()), np.uint32)
                ends = np.concatenate(([0], np.cumsum(by_code[codes] * counts)))
                begins = np.concatenate(([0], np.cumsum(n_words.values.to_numpy())))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.values, n_bytes.values, pa.array(np.diff(ends[begins]))], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


#: More tokens than this is over the limit.
MAX_TOKENS = 2048


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


QUERIES: dict[str, tuple[Callable, str | None]] = {"op3_token_counts": (op3_token_counts, None)}
