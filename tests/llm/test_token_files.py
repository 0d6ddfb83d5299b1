import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import rans
from ledgerloom.llm import token_files as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(docs):
    library = Tokenizer.from_file(PATH)
    rows, start = [], 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        rows.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_round_trip_of_odd_documents(spark, odd_docs, tmp_path):
    manifest = op.write_files(odd_docs, PATH, f"file://{tmp_path}")
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in op.read_files(manifest).collect())
    assert got == expected(odd_docs.collect())


def test_whole_table_over_several_files(spark, sf_dir, monkeypatch):
    got = sorted(tuple(r) for r in op.op6_token_files(spark, sf_dir).collect())
    assert got == expected(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def test_null_id_and_empty_table(spark, no_docs, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    rows = op.read_files(op.write_files(docs, PATH, f"file://{tmp_path}")).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(None, 3), (3, 1)]
    assert op.read_files(op.write_files(no_docs, PATH, f"file://{tmp_path}")).collect() == []


@pytest.mark.parametrize("n,vocabulary", [(1, 1), (17, 3), (40_000, 5), (100_000, 49_000), (rans.BLOCK_IDS, 70_000)])
def test_coder_round_trip(n, vocabulary):
    ids = (np.random.default_rng(n).random(n) ** 3 * vocabulary).astype(np.uint32)
    symbols, freqs, bits = rans.frequencies(ids)
    assert freqs.sum() == 1 << bits and freqs.min() >= 1
    blocks = rans.encode_blocks(ids, symbols, freqs, bits)
    assert (rans.decode_blocks(blocks, symbols, freqs, bits) == ids).all()
    assert (rans.decode_blocks(blocks[-1:], symbols, freqs, bits) == ids[(len(blocks) - 1) * rans.BLOCK_IDS :]).all()


def test_damage_is_found():
    data = bytearray(op.to_bytes([5], np.array([50_000]), np.arange(50_000, dtype=np.uint32)))
    op.from_bytes(bytes(data))
    data[-7] ^= 1
    with pytest.raises(ValueError):
        op.from_bytes(bytes(data))
