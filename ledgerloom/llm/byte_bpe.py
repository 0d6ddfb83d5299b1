"""Byte-level BPE by a rank file, with the tokenizers library over Arrow batches, and its inverse.

The library works on characters, so each byte has a character (``BYTE_CHARS``); ids map to bytes by reversing that
table. Merges are all splits of a ranked token into two ranked tokens, in the order of ranks, which is what a
rank-driven encoder can merge. Offsets are characters of the text: a token's bytes begin in the character that holds
its first byte. Decoding joins bytes before it decodes characters, so characters split over ids come back whole.

Null text: empty, no ids. Repeated rows: a row each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import buffers, spread_ranges, table, text_columns, text_slices
from ledgerloom.llm.tokens import ChunkEncoder

#: Bytes of text encoded and of ids decoded at once, and chunks that a worker keeps: a task has two workers.
SLICE_BYTES, ID_BYTES, CACHE_CHUNKS = 4 << 20, 2 << 20, 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next character from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


BYTE_CHARS = byte_characters()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def library_json(ranks: dict[bytes, int], pattern: str) -> str:
    """Definition of a tokenizer of the library that encodes by these ranks."""

    def chars(token: bytes) -> str:
        return "".join(map(BYTE_CHARS.__getitem__, token))

    merges = [
        [chars(token[:cut]), chars(token[cut:])]
        for token in sorted(ranks, key=ranks.get)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                  "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": {chars(t): r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True},
    })


def spaced_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks that begin at single spaces between two characters that are no white space, and each text's first chunk.

    A match of the pattern always begins at such a space, so chunks are encoded apart. Where a neighbour may belong
    to a white-space character of several bytes nothing is cut.
    """
    data, offsets = buffers(texts)
    if not len(data):
        return pa.array([""] * len(texts), pa.string()), np.arange(len(texts) + 1)
    padded = np.concatenate((np.zeros(2, np.uint8), data, np.zeros(1, np.uint8)))
    following, before, second = padded[3:], padded[1:-2], padded[:-3]
    plain_next = (following > 32) & ~np.isin(following, (0xC2, 0xE1, 0xE2, 0xE3))
    plain_before = (before > 32) & ((before < 0x80) | ((second >= 0xC3) & (second <= 0xDF)))
    cut = (data == 32) & plain_next & plain_before
    inner = offsets[1:-1]
    cut[inner[inner < len(data)]] = False  # a text's first byte begins a chunk anyway
    places = np.flatnonzero(cut)
    # texts may be empty, so their starts are merged as positions, not as marks
    begins = np.arange(len(texts)) + np.searchsorted(places, offsets[:-1])
    starts = np.insert(places, np.searchsorted(places, offsets[:-1]), offsets[:-1])
    bounds = np.concatenate((starts, [len(data)])).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data))
    return chunks, np.concatenate((begins, [len(starts)]))


class TokenBytes:
    """The bytes of every id, from the characters of the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]):
        back = {char: byte for byte, char in enumerate(BYTE_CHARS)}
        size = max(vocabulary.values()) + 1
        tokens = [b""] * size
        for chars, rank in vocabulary.items():
            tokens[rank] = bytes(map(back.__getitem__, chars))
        self.sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread_ranges(self.starts[ids], self.sizes[ids])]


@functools.cache
def rank_encoder(path: str, pattern: str) -> ChunkEncoder:
    """The encoder of a rank file; tasks that follow each other in a worker share it."""
    return ChunkEncoder(Tokenizer.from_str(library_json(read_ranks(path), pattern)), spaced_chunks, None, CACHE_CHUNKS)


def character_offsets(text_bytes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character of consecutive tokens with ``sizes`` bytes; a split character counts for all its tokens."""
    character = np.cumsum((text_bytes & 0xC0) != 0x80)
    ends = np.cumsum(sizes)
    return character[ends - sizes] - 1, character[ends - 1]


def decode_pieces(ids: list[int], tokens: TokenBytes) -> list[str]:
    """Text that becomes complete with each id: a character split over ids appears with its last one."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    pieces = [decoder.decode(tokens.join(np.array([i])).tobytes()) for i in ids]
    return pieces[:-1] + [pieces[-1] + decoder.decode(b"", True)] if pieces else []


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit; with ``offsets`` also (starts, ends) in characters, packed alike."""
    names = ["doc_id", "ids"] + ["starts", "ends"] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern)
        tokens = TokenBytes(encoder.tokenizer.get_vocab()) if offsets else None
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids, lengths = encoder.encode(part.column(1))
                columns = [ids]
                if offsets:
                    data, at = buffers(part.column(1))
                    first, last = character_offsets(data, tokens.sizes[ids])
                    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at[:-1]]
                    columns += [first - np.repeat(before, lengths), last - np.repeat(before, lengths)]
                bounds = (4 * np.concatenate(([0], np.cumsum(lengths)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [
                        pa.BinaryArray.from_buffers(
                            pa.binary(), part.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(c.astype("<u4").tobytes())]
                        ) for c in columns
                    ],
                    names=names,
                )

    schema = "doc_id long, " + ", ".join(f"{name} binary" for name in names[1:])
    return text_columns(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        tokens = TokenBytes({"".join(map(BYTE_CHARS.__getitem__, t)): r for t, r in ranks.items()})
        for batch in batches:
            for part in text_slices(batch, "ids", ID_BYTES):
                raw, at = buffers(part.column(1))
                ids = np.frombuffer(raw.tobytes(), "<u4")
                ends = np.concatenate(([0], np.cumsum(tokens.sizes[ids])))[at // 4].astype(np.int32)
                decoded = pa.BinaryArray.from_buffers(
                    pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(tokens.join(ids).tobytes())]
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, tuple[Callable, str | None]] = {"op10_byte_bpe": (op10_byte_bpe, None)}
