import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import token_counts as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    library = Tokenizer.from_file(PATH)
    return sorted(
        (r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows
    )


def test_counts_equal_the_library(spark, odd_docs):
    got = sorted(tuple(r) for r in op.token_counts(odd_docs, PATH).collect())
    assert got == expected(odd_docs.collect())


def test_small_blocks_and_whole_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 50_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op.op3_token_counts(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == expected(docs.collect())
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_empty_table(no_docs):
    assert op.token_counts(no_docs, PATH).collect() == []


def test_more_batches_of_a_partition_than_any_bit_field_holds(spark):
    rows = [(i, f"word{i % 97} again{i % 5}" + " x" * (i % 7)) for i in range(8600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = sorted(tuple(r) for r in op.token_counts(docs, PATH).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(docs.collect())
