import math
import re

import pytest
import regex
import xxhash

from ledgerloom.llm import quality as op


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def h(value, seed=42):
    return xxhash.xxh64_intdigest(value.encode(), seed)


def brute_buckets(text):
    pieces = regex.findall(op.PIECES, (text or "").lower())
    signed = [h(p) for p in pieces] + [h(b, h(a)) if b is not None else h(a) for a, b in zip(pieces, pieces[1:] + [None])]
    return [(v - (v >> 63 << 64)) % op.BUCKETS for v in signed]


def brute_ratios(docs, good):
    raw_n, good_n = [1.0] * op.BUCKETS, [1.0] * op.BUCKETS
    for doc_id, text in docs:
        for b in brute_buckets(text):
            raw_n[b] += 1
            good_n[b] += doc_id in good
    all_good, all_raw = sum(good_n), sum(raw_n)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good_n, raw_n)]


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.trusted_id for r in op.trusted_ids(labels).collect()}
    assert good <= {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic} and len(good) > 30
    ratios = brute_ratios(docs.items(), good)
    rows = op.op2_quality(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = brute_base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        own = brute_buckets(docs[r.doc_id])
        ratio = sum(ratios[b] for b in own) / len(own)
        assert r.ratio == pytest.approx(ratio, abs=1e-9) and r.kept == (not base[-1] and round(r.ratio, 9) >= op.THRESHOLD)


def test_odd_rows(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    line = " ".join(f"w{i}" for i in range(30))
    extra = [(20, f"{line}\n{line}\nx\n \n\n"), (21, "a b c d e f g h " * 3), (22, line + " #*$%&|<> é 🙂"), (None, "x")]
    docs = odd_docs.select("doc_id", "text", "n_tokens").union(spark.createDataFrame([(*e, 1) for e in extra], "d long, t string, n int"))
    texts.update(extra)
    rows = op.judge(docs, [0.0] * op.BUCKETS).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base and r.ratio == 0
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (2, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert any(op.fit(odd_docs, labels)) and not any(op.fit(odd_docs, labels.limit(0))) and not any(op.fit(no_docs, labels))
    assert op.judge(no_docs, op.fit(no_docs, labels)).collect() == []


def test_only_data_frame_functions_run(spark, sf_dir):
    plan = op.op2_quality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_good_documents_stay_and_bad_ones_go(spark):
    rows = op.op2_quality(spark, "/root/testdata/sf0.01").alias("r")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = rows.join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in found if r.quality == 1], [r.kept for r in found if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)
