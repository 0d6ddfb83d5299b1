import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from ledgerloom.llm import byte_bpe as op

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=op.read_ranks(PATH), special_tokens={})


def expected(library, docs):
    rows = []
    for r in docs:
        ids, text = library.encode_ordinary(r.text or ""), (r.text or "").encode()
        raw = np.array(ids, "<u4").tobytes()
        rows.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()))
    return sorted(rows)


def test_whole_table_equals_the_rank_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(tuple(r) for r in op.op10_byte_bpe(spark, sf_dir).collect()) == expected(library, docs)


def test_odd_texts_and_offsets(spark, odd_docs, no_docs, library):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in op.encode(odd_docs, PATH, PATTERN, offsets=True).collect():
        text = texts[r.doc_id]
        ids, starts, ends = (np.frombuffer(c, "<u4").tolist() for c in (r.ids, r.starts, r.ends))
        assert ids == library.encode_ordinary(text)
        character = [i for i, c in enumerate(text) for _ in c.encode()]
        at = 0
        for i, start, end in zip(ids, starts, ends):
            size = len(library.decode_single_token_bytes(i))
            assert (start, end) == (character[at], character[at + size - 1] + 1)
            at += size
    assert op.decode(op.encode(no_docs, PATH, PATTERN), PATH).collect() == []


def test_random_texts_with_every_kind_of_white_space(library):
    encoder = op.rank_encoder(PATH, PATTERN)
    draw = random.Random(3)
    alphabet = list("ab Z'sdé9 \n\t\x0b\x1c\x85\xa0   　日本-!́🙂ß ")
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(4000)]
    ids, lengths = encoder.encode(pa.array(texts))
    ends = np.cumsum(lengths)
    for text, end, length in zip(texts, ends, lengths):
        assert ids[end - length : end].tolist() == library.encode_ordinary(text), repr(text)


def test_split_characters_come_back_whole(library):
    tokens = op.TokenBytes({"".join(map(op.BYTE_CHARS.__getitem__, t)): r for t, r in op.read_ranks(PATH).items()})
    ids = library.encode_ordinary("a 🙂👍🏽 é日")
    pieces = op.decode_pieces(ids, tokens)
    assert "".join(pieces) == "a 🙂👍🏽 é日" and "" in pieces
    assert op.decode_pieces(library.encode_ordinary("齉")[:1], tokens) == ["�"]
