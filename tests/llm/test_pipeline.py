import numpy as np
import public_tokenizers
import pytest
import zlib
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import language, secrets
from test_jaccard import brute
from test_quality import brute_base, brute_ratios, brute_buckets
from ledgerloom.llm import quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input rows and output rows of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        seen.append((name, docs.collect(), rows, docs.columns, out.columns))
        docs = spark.createDataFrame(rows, out.schema)
    return {name: rest for name, *rest in seen}


def test_names_and_columns(stages):
    assert list(stages) == ["language", "quality", "jaccard", "secrets", "packing"]
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or before == after


def test_language(spark, stages):
    before, after, *_ = stages["language"]
    frame = spark.createDataFrame(before)
    kept = {r.doc_id for r in language.predict(frame, language.fit(frame)).collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    assert {r.doc_id for r in after} == kept and len(kept) >= 0.97 * len(before)


def test_quality(spark, stages, sf_dir):
    before, after, *_ = stages["quality"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.trusted_id for r in quality.trusted_ids(labels).collect()}
    ratios = brute_ratios([(r.doc_id, r.text) for r in before], good)
    kept = []
    for r in before:
        own = brute_buckets(r.text)
        if not brute_base(r.text)[-1] and sum(ratios[b] for b in own) / len(own) >= quality.THRESHOLD:
            kept.append(r)
    assert sorted(after) == sorted(kept) and 0 < len(kept) < len(before)


def test_jaccard(stages):
    before, after, *_ = stages["jaccard"]
    components = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in before])}
    assert sorted(after) == sorted(r for r in before if components[r.doc_id] == r.doc_id) and len(after) < len(before)


def test_secrets(stages):
    before, after, *_ = stages["secrets"]
    texts = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        own = texts[r.doc_id]
        assert own.text == secrets._redacted(r.text, "[secret]", secrets.MIN_BITS) and not secrets.base_spans(own.text)
        assert own.n_chars == (len(own.text) if own.text != r.text else r.n_chars)


def test_packing_and_run(spark, stages, sf_dir):
    before, after, *_ = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in before[:40]:
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted((p.start, p.length, p.ids_crc32) for p in after if p.doc_id == r.doc_id)
        assert pieces == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in pieces] and sum(p[1] for p in pieces) == len(ids)
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in run) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in after)


def test_odd_and_empty_inputs(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= 100 and (out.columns == docs.columns or "sequence_id" in out.columns)
    assert corpus_pipeline.one_of_each(spark, odd_docs, sf_dir).count() == odd_docs.count() - 1  # document 1 stands there twice
