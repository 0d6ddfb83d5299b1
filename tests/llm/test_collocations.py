import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle_support import compare, connect

from ledgerloom.llm import collocations as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    return counts, total


def brute(rows, least=30, top=2000):
    counts, total = brute_counts(rows)
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    covered = {}
    for (lang, words), f in candidates.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = lang, words[i : i + n]
                covered[key] = max(covered.get(key, 0), f)
    found = {}
    for (lang, words), a in candidates.items():
        if 100 * covered.get((lang, words), 0) >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, own in found.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], start=1)
    )


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_whole_table_equals_brute_force(spark, sf_dir):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = brute(rows)
    assert got(op.op12_collocations(spark, sf_dir)) == wanted and len(wanted) > 20


def test_whole_table_equals_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), op.op12_collocations, op._SQL, sf_dir)[1] is None


def mixture(n, seed=5):
    draw = random.Random(seed)
    vocabulary = ["A", "a", "é", "λόγος", "\x1c", "don't", "x" * 90, *(f"w{i}" for i in range(12))]
    stock = [[draw.choice(vocabulary) for _ in range(k)] for k in (2, 3, 4, 4, 6)]
    rows = []
    for _ in range(n):
        words = [w for _ in range(draw.randint(0, 12)) for w in (draw.choice(stock) if draw.random() < 0.4 else [draw.choice(vocabulary)])]
        rows.append((draw.choice(["en", "en", "en", "de", None, "und"]), "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for w in words)))
    return rows + [("en", None), (None, ""), ("fr", " \t"), ("fr", "once only")] + rows[:9]


@pytest.mark.parametrize("limits", [{}, {"BURST": 5, "LIMIT": 40, "PART_BYTES": 200}, {"WORD_LIMIT": 3, "SLICE_BYTES": 50, "PART_BYTES": 1}])
def test_random_phrases_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(op, name, value)
    rows = mixture(60)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1L as n", "'p' as phrase", "2 as f", "3L as doc_id")
    assert got(op.collocations(docs.repartition(3), least=4, top=25)) == brute(rows, least=4, top=25)


def test_a_full_bloom_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "passes", lambda known, h: np.ones(len(h), bool))
    rows = mixture(40, seed=8)
    assert got(op.collocations(spark.createDataFrame(rows, "lang string, text string"), least=3)) == brute(rows, least=3)


def test_nulls_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert got(op.collocations(odd_docs)) == brute(rows)
    assert op.collocations(no_docs).collect() == []


def test_trie_bursts_and_gives_subtrees_whole(monkeypatch):
    monkeypatch.setattr(op, "BURST", 50)
    draw = np.random.default_rng(2)
    trie, plain, taken = op.HatTrie(), Counter(), Counter()
    for _ in range(30):
        prefix, ending = draw.integers(0, 1 << 62, 12)[draw.integers(0, 12, 80)], draw.integers(0, 40, 80)
        plain.update(zip(prefix.tolist(), ending.tolist()))
        trie.add(prefix, ending)
        if trie.size > 150:
            some = trie.take(60)
            assert trie.size <= 60 and not set(some[0].tolist()) & set(trie.children)
            for p, e, n in zip(*(column.tolist() for column in some)):
                taken[p, e] += n
    for p, e, n in zip(*(column.tolist() for column in trie.take(0))):
        taken[p, e] += n
    assert taken == plain and trie.size == 0


def test_bloom_filter_loses_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_BITS", op.CHUNK)
    phrases = [("en", f"a{i} b{i % 7}") for i in range(3000)] + [("de", f"a{i} b{i % 7}") for i in range(0, 3000, 5)]
    known = op.bloom(spark.createDataFrame(phrases, "lang string, phrase string").repartition(4))
    words = [p.split() for _, p in phrases]
    columns = [op.hashes(pa.array([w[k].encode() for w in words], pa.binary())) for k in range(2)]
    lang = np.array([op.lang_hashes([lang])[0] for lang, _ in phrases])
    assert op.passes(known, op.phrase_hashes(columns, lang)).all()
