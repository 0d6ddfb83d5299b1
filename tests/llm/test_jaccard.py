import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard as op
from ledgerloom.llm.components import connected
from ledgerloom.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}


def brute(rows):
    """(doc_id, size, component) of every (doc_id, text)."""
    sets = [brute_set(text) for _, text in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                common = len(sets[a] & sets[b])
                if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                    parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def copies(n, words, edits, seed, first=0):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(words)] = f"x{draw.randint(0, 10**6)}"
        rows.append((first + i, " ".join(own)))
    return rows


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op.op8_jaccard(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize(
    "limits", [{}, {"HOT": 3, "BLOCK": 16, "FREQUENT": 2}, {"HOT": 2, "BLOCK": 7, "FREQUENT": 1, "CELLS": 64, "CHUNK": 16},
               {"HOT": 2, "BLOCK_SHINGLES": 500, "FREQUENT": 10**9}])
def test_groups_of_copies_small_and_large(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(op, name, value)
    draw = random.Random(9)
    rows = copies(70, 90, 4, 1) + copies(30, 12, 1, 2, 100) + copies(20, 400, 30, 3, 200)
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(300 + i, passage + " " + " ".join(f"y{draw.randint(0, 10**6)}" for _ in range(60))) for i in range(40)]
    rows += [(400 + i, rows[i][1].upper()) for i in range(5)] + [(500, "a b"), (501, "A  b"), (502, "a"), (503, None), (504, " \n"), (505, "")]
    rows += [(506, " ".join("abcdefghijk")), (507, " ".join("abcdefghijkl"))]  # 9 of 10 shingles: exactly 90 percent
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(op.join(docs)) == brute(rows)


def test_repeated_ids_nulls_and_empty(spark, odd_docs, no_docs):
    rows = [(5, "a b c d"), (5, "q r s t"), (3, "q r s t"), (9, "a b c d"), (None, "a b c d"), (7, None), (None, None)]
    assert got(op.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert op.join(no_docs).collect() == []
    assert got(op.join(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_hashed_sets_have_the_sizes_of_the_sets():
    texts = ["A b\x0bc d a B c", "", None, "x", "é É", "a\x85b c", "one two three one two three", " lead  and trail "]
    assert [len(s) for s in shingle_sets(pa.array(texts), 3)] == [len(brute_set(t)) for t in texts]


def test_intersections_of_random_sets():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 200, draw.integers(1, 150)).astype(np.uint64)) for _ in range(60)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    found = op.intersections(sets)
    assert all(found[i, j] == expected[i][j] for i in range(60) for j in range(60) if i != j)


def test_components_of_random_graphs(spark):
    draw = random.Random(7)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    wanted = {i: root(i) for a, b in edges if a != b for i in (a, b)}
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == wanted and len(found) == len(wanted)


@pytest.mark.parametrize("percent", [30, 50])
def test_small_sets_link_at_low_percents(spark, percent):
    draw = random.Random(3)
    rows = [(0, "a b c"), (1, "a b c d"), (2, "q r s"), (3, "q r s t u")]
    rows += [(10 + i, " ".join(draw.choice("klmnop") for _ in range(draw.randint(3, 6)))) for i in range(60)]
    sets, component = {i: brute_set(text) for i, text in rows}, {i: i for i, _ in rows}
    for a, b in [(a, b) for _ in rows for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]:
        component[a] = component[b] = min(component[a], component[b])
    wanted = sorted((i, len(sets[i]), component[i]) for i in sets)
    assert got(op.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == sorted(wanted, key=str)


def test_unrelated_texts_with_stock_phrases_are_hardly_ever_compared(spark, monkeypatch):
    """Even where no shingle is known to be frequent: a stock phrase or two in a prefix do not make room for a link."""
    monkeypatch.setattr(op, "FREQUENT", 10**9)
    monkeypatch.setattr(op, "HOT", 4)
    draw = random.Random(12)
    stock = [[f"s{k}_{i}" for i in range(8)] for k in range(40)]
    rows = []
    for i in range(1500):
        parts = [draw.choice(stock) if draw.random() < 0.3 else [f"u{draw.randint(0, 10**7)}" for _ in range(8)] for _ in range(40)]
        rows.append((i, " ".join(w for part in parts for w in part)))
    met = []
    links = op.verified_links
    monkeypatch.setattr(op, "verified_links", lambda docs, members, *more: met.append(members) or links(docs, members, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert all(r.component_id == r.doc_id for r in op.join(docs).collect())
    compared = met[0].groupBy("cluster").count().where("count > 1").collect()
    assert len(compared) <= 5 and all(r["count"] == 2 for r in compared)


def test_pairs_that_link_always_fit():
    draw = np.random.default_rng(6)
    for percent in (50, 80, 90):
        for _ in range(200):
            base = np.unique(draw.integers(0, 10**6, draw.integers(2, 120)))
            other = np.unique(np.concatenate([base[draw.random(len(base)) < draw.uniform(0.8, 1)], draw.integers(0, 10**6, draw.integers(0, 12))]))
            if 100 * len(np.intersect1d(base, other)) < percent * len(np.union1d(base, other)) or not len(other):
                continue
            rank = dict(zip(draw.permutation(np.union1d(base, other)).tolist(), range(10**6)))
            prefixes = [sorted(s.tolist(), key=rank.get)[: op.prefix_length(len(s), percent)] for s in (base, other)]
            shared = len(set(prefixes[0]) & set(prefixes[1]))
            sizes, lengths = np.array([len(base), len(other)]), np.array([len(p) for p in prefixes])
            assert op.fitting(sizes, lengths, np.full((2, 2), shared), percent)[0, 1]


def test_pairs_that_link_fit_by_the_ends_of_their_ordered_prefixes_too():
    draw = np.random.default_rng(8)
    refused = 0
    for percent in (30, 50, 80, 90):
        for _ in range(150):
            levels = draw.integers(0, draw.integers(1, 5), 16).astype(np.uint8)
            base = draw.integers(0, 400, draw.integers(2, 120))
            sets = []
            for _ in range(5):
                own = base[draw.random(len(base)) < draw.uniform(0.7, 1)]
                sets.append(np.unique(np.concatenate([own, draw.integers(0, 400, draw.integers(1, 12))])).astype(np.uint64))
            prefixes = [s[np.argsort(op.levels_of(s, levels), kind="stable")][: op.prefix_length(len(s), percent)] for s in sets]
            heads = op.heads(prefixes, levels)
            sizes, lengths = np.array([len(s) for s in sets]), np.array([len(p) for p in prefixes])
            shared = np.array([[len(np.intersect1d(a, b)) for b in prefixes] for a in prefixes])
            fits = op.fitting(sizes, lengths, shared, percent, heads)
            assert (fits == fits.T).all() and not (fits & ~op.fitting(sizes, lengths, shared, percent)).any()
            refused += (~fits & op.fitting(sizes, lengths, shared, percent)).sum()
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if i != j and shared[i, j] and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                        assert fits[i, j]
    assert refused
