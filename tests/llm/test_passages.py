import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import passages as op
from ledgerloom.llm import words


def brute(rows, n=13):
    """(doc_id, n_words, n_removed, kept) of every (doc_id, text)."""
    least, cut = {}, [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    for (doc_id, _), w in zip(rows, cut):
        for i in range(len(w) - n + 1 if doc_id is not None else 0):
            key = tuple(w[i : i + n])
            least[key] = min(least.get(key, doc_id), doc_id)
    found = []
    for (doc_id, _), w in zip(rows, cut):
        gone = set()
        for i in range(len(w) - n + 1 if doc_id is not None else 0):
            if least[tuple(w[i : i + n])] < doc_id:
                gone.update(range(i, i + n))
        found.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(found, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_table_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    wanted = [(i, n, k, hashlib.sha256(text.encode()).hexdigest()) for i, n, k, text in brute(rows)]
    assert got(op.op13_passages(spark, sf_dir)) == sorted(wanted, key=str)
    assert any(k for _, _, k, _ in wanted)


def mixture():
    draw = random.Random(3)
    vocabulary = ["A", "a", "é", "x" * 70, "y" * 200, "λόγος", "\x1c", "b.", *(f"w{i}" for i in range(30))]
    def some(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    stock = [some(k) for k in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(300):
        parts = [w for _ in range(draw.randint(0, 4)) for w in (draw.choice(stock) if draw.random() < 0.5 else some(draw.randint(0, 30)))]
        rows.append((draw.randint(-50, 250) if draw.random() < 0.97 else None, draw.choice(["", " ", "\n"]) + draw.choice([" ", "\t\n", "  "]).join(parts)))
    return rows + rows[:20] + [(5, None), (6, ""), (None, None), (400, " \n\t")]


@pytest.mark.parametrize("block,part,cells,parts", [(1 << 23, 1 << 21, 8, 3), (2000, 64, 8, 5), (1, 500, 1, 40)])
def test_random_passages_equal_brute_force(spark, monkeypatch, block, part, cells, parts):
    for name, value in (("BLOCK_BYTES", block), ("PART", part), ("CELLS", cells)):
        monkeypatch.setattr(op, name, value)
    rows = mixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' as path", "1L as n_words", "'k' as kept")
    assert got(op.dedup(docs.repartition(parts))) == brute(rows)


def test_other_window_lengths_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for n in (1, 2, 5):
        assert got(op.dedup(odd_docs, n)) == brute(rows, n)
    assert op.dedup(no_docs).collect() == []
    with pytest.raises(ValueError):
        op.dedup(odd_docs, 0)


def test_a_filter_that_passes_everything_changes_nothing(spark, monkeypatch):
    rows = mixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(op, "_held", lambda values, asked: np.ones(len(asked), bool))
    assert got(op.dedup(docs)) == brute(rows)


def test_windows_of_a_block_are_hashed_in_two_passes_and_sorted_in_one(spark, monkeypatch, tmp_path):
    rows = mixture()
    hashed = str(tmp_path)

    class Counted(op.Block):
        def rolled(self, words, families):
            import uuid
            open(f"{hashed}/{families}-{uuid.uuid4().hex}", "w").close()
            return op.Block.rolled(self, words, families)

    monkeypatch.setattr(op, "Block", Counted)
    monkeypatch.setattr(op, "BLOCK_BYTES", 4000)
    written = []
    blocks = op.write_blocks
    monkeypatch.setattr(op, "write_blocks", lambda *given: written.append(blocks(*given)) or written[0])
    assert got(op.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
    names = [path.name[:2] for path in tmp_path.iterdir()]
    n = written[0].count()
    assert n > 3 and sorted(names) == ["1-"] * n + ["2-"] * n


def test_words_end_at_the_borders_of_texts():
    for texts in (["a", "b", None, "", "c d", "e"], ["", " a", "b "], [None], [], ["x y", "z"]):
        column = pa.array(["before", *texts, "after"], pa.string())[1 : len(texts) + 1]
        found = words.places(column, False)
        assert [bytes(found.data[a : a + n]).decode() for a, n in zip(found.starts, found.lengths)] == " ".join(t or "" for t in texts).split()
        assert np.diff(found.begins).tolist() == [len((t or "").split()) for t in texts]


def test_marks_of_no_windows_and_of_some():
    assert op.removed(0, op.pack(np.zeros(0, np.uint8), np.zeros(0, np.uint8)), op.pack(np.zeros(0, "<u4")), np.zeros(0, bool)).tolist() == []
    marked = op.pack(np.packbits([True, False, False, False]), np.packbits([False, True, True, False]))
    assert op.removed(4, marked, op.pack(np.array([1, 0], "<u4")), np.array([True, False])).tolist() == [True, False, True, False]


def test_words_and_hashes_follow_the_bytes():
    texts = ["A b\x0bc  d", "", None, "x", "é É a\x85b", " lead and trail ", "end", "q" * 63, "q" * 64, "q" * 65, "q" * 66]
    for lower in (False, True):
        found = words.cut(pa.array(texts), lower)
        spelled = [found.distinct[i].as_py().decode() for i in found.codes.tolist()]
        plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        wanted = [w if not lower else re.sub("[A-Z]", lambda m: m[0].lower(), w) for ws in plain for w in ws]
        assert spelled == wanted and np.diff(found.begins).tolist() == [len(w) for w in plain]
        assert [bytes(found.data[a : a + n]).decode() for a, n in zip(found.starts, found.lengths)] == wanted
    one, two = (words.hashes(found.distinct, family) for family in range(2))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(found.distinct) and not set(one.tolist()) & set(two.tolist())
    again = words.hashes(found.distinct.take(pa.array(range(len(found.distinct) - 1, -1, -1))))
    assert again[::-1].tolist() == one.tolist()
