import math
import zlib

import numpy as np
import pytest

from ledgerloom.llm import language as op


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def net(docs):
    return op.fit(docs)


def test_held_out_accuracy(spark, docs, net):
    rows = op.predict(docs, net).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang is not None]
    right = sum(r.lang_pred == r.lang for r in held)
    assert len(held) > 100 and right >= 0.97 * len(held)


def test_query_contract(spark, sf_dir):
    rows = op.op7_language(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_sample_leaves_out_the_held_out_fold(spark):
    rows = [(i, f"text {i} " + "ab" * 100, "xx") for i in range(40)] + [(None, "null id", "xx"), (3, None, "xx"), (5, "5 6", "xx"), (6, "no label", None)]
    sample = op.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = {f"text {i} " + "ab" * 100 for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sample and all(any(window in text for text in own) for _, window in sample)


def test_gradient_equals_finite_differences():
    net = op.Network(["a", "b", "c"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    draw = np.random.default_rng(2)
    data, sizes, labels = draw.integers(0, 256, (5, 7)).astype(np.uint8), np.array([7, 3, 1, 7, 5]), np.array([0, 1, 2, 1, 0])
    _, gradient = net.gradient(data, sizes, labels)
    for name, weights in net.p.items():
        flat = weights.reshape(-1)
        places = draw.choice(len(flat), min(12, len(flat)), replace=False) if name != "x" else [
            np.ravel_multi_index((d, data[0, t], k), weights.shape) for d in (0, 1) for t in (0, 3) for k in (0, 9, 20)]
        for i in places:
            old = flat[i]
            flat[i] = old + 1e-2
            up = net.gradient(data, sizes, labels)[0]
            flat[i] = old - 1e-2
            down = net.gradient(data, sizes, labels)[0]
            flat[i] = old
            assert abs((up - down) / 2e-2 - gradient[name].reshape(-1)[i]) < 2e-4, (name, i)


def test_a_text_does_not_depend_on_its_neighbours(net):
    texts = [b"the end of that", b"", b"x" * 5000, "été".encode(), bytes(range(256)) * 3]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    together = net.probabilities(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, row in zip(texts, together):
        alone = net.probabilities(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert np.allclose(alone, row, atol=1e-5) and abs(row.sum() - bool(text)) < 1e-4


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, net):
    rows = op.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 4)} == {i: ("und", 0.0) for i in (2, 3, 4)}
    assert op.predict(no_docs, net).collect() == []
    nothing = op.fit(no_docs)
    assert {(r.lang_pred, r.score) for r in op.predict(odd_docs, nothing).collect()} == {("und", 0.0)}
    one = op.fit(odd_docs.where("doc_id = 1"))
    assert {r.lang_pred for r in op.predict(odd_docs, one).collect()} <= {"en", "und"}


def plain_probabilities(net, text):
    """Byte after byte in both directions, stretch after stretch, without any batching."""
    hidden = op.HIDDEN

    def states(stretch, direction):
        h, found = [0.0] * hidden, []
        for byte in stretch:
            seen = net.p["x"][direction][byte]
            own = [sum(h[i] * float(net.p["u"][direction][i][j]) for i in range(hidden)) for j in range(3 * hidden)]
            gate = [min(1.0, max(0.0, 0.25 * (float(seen[j]) + own[j]) + 0.5)) for j in range(2 * hidden)]
            fresh = [float(seen[2 * hidden + j]) + gate[hidden + j] * own[2 * hidden + j] for j in range(hidden)]
            fresh = [v / (1 + abs(v)) for v in fresh]
            h = [fresh[j] + gate[j] * (h[j] - fresh[j]) for j in range(hidden)]
            found.append(h)
        return found

    total = [0.0] * len(net.labels)
    for first in range(0, len(text), op.STRETCH):
        stretch = text[first : first + op.STRETCH]
        for forward, backward in zip(states(stretch, 0), states(stretch[::-1], 1)[::-1]):
            logits = [
                sum(forward[i] * float(net.p["o"][0][i][k]) + backward[i] * float(net.p["o"][1][i][k]) for i in range(hidden)) + float(net.p["c"][k])
                for k in range(len(net.labels))
            ]
            powers = [math.exp(v) for v in logits]
            total = [t + v / sum(powers) for t, v in zip(total, powers)]
    return [t / len(text) for t in total]


def test_probabilities_equal_a_plain_loop_over_bytes(net):
    texts = ["the end", "ä", "Le chat est là. " * 12, "x" * op.STRETCH, "der Hund und " * 25]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(t) for t in data])
    found = net.probabilities(np.frombuffer(b"".join(data), np.uint8), offsets)
    for text, row in zip(data, found):
        assert np.allclose(row, plain_probabilities(net, text), atol=1e-4)


def test_columns_of_the_result_may_clash(spark, net):
    frame = spark.createDataFrame([(1, "the end of it", "old", 3.0)], "doc_id long, text string, lang_pred string, score double")
    got = op.predict(frame, net)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.first().lang_pred in net.labels
    assert op.keep_known(frame.withColumn("lang", op.F.lit("en"))).columns == [*frame.columns, "lang"]
