import numpy as np
from oracle_support import compare, connect
from pyspark.sql import functions as F

from ledgerloom.llm import block_search as op


def brute(rows, k):
    """(query, rank, id, score) for every id divisible by 20 among (id, vector)."""
    found = []
    for q, x in rows:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in rows if c != q and len(y) == len(x))
            found += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(found)


def test_whole_table_equals_sql(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op, "CANDIDATE_ROWS", 120)
    monkeypatch.setattr(op, "QUERY_ROWS", 10)
    assert compare(spark, connect(sf_dir), op.op1_block_search, op._SQL, sf_dir)[1] is None


def test_ties_equal_vectors_and_fewer_candidates(spark, monkeypatch):
    monkeypatch.setattr(op, "CANDIDATE_ROWS", 40)
    monkeypatch.setattr(op, "TILE_ROWS", 11)
    draw = np.random.default_rng(1)
    rows = [(i, draw.integers(-3, 4, 5).astype(float).tolist()) for i in range(100)]
    rows = [(i, x if any(x) else [1.0] * 5) for i, x in rows] + [(200 + i, [1.0, 2.0]) for i in range(3)] + [(140, [3.0, 1.0])]
    frame = spark.createDataFrame(rows + rows[:30], "vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    got = sorted(tuple(r) for r in op.nearest(frame, F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == brute(rows, 7)


def test_unusable_vectors_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(20 * i, x) for i, x in enumerate(bad)] + [(None, [1.0, 1.0]), (1000, [1.0, 1.0]), (1001, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in op.nearest(frame, F.col("vec_id") % 20 == 0).collect()]
    assert got == [(1000, 1, 1001, 3.0)]
    assert op.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold_for_large_and_small_components():
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(50, 1500)) * 10.0 ** draw.integers(-8, 8, (50, 1)), draw.normal(size=(60, 1500))
    a, sa, na, ra = op.quantise(x)
    b, sb, nb, rb = op.quantise(y)
    near = op.int8_products(a, b) * sa[:, None] * sb
    error = na[:, None] * rb + ra[:, None] * (nb + rb)
    assert (np.abs(near - x @ y.T) <= error * (1 + 1e-9)).all()
    assert (op.int8_products(a, b) == a.astype(int) @ b.astype(int).T).all()
