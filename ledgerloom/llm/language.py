"""Language of whole texts by a bidirectional gated recurrent network over bytes, trained in numpy.

Every byte gets label probabilities from the states of both directions; a document's probabilities are their mean.
Training runs on the driver by backpropagation through time over a bounded sample: at most ``PER_LABEL`` windows of
``STEPS`` bytes per label, one from each document of the hashed sample. Prediction covers every byte of every text, in
stretches of ``STRETCH`` bytes that start from the zero state, so memory does not depend on a text's length and a
result does not depend on the other rows.

Null text or a text without letters: ``und`` with score 0. Without any labelled text every result is ``und``. A null
doc_id is never held out and never learned from. Repeated rows: a row each. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import buffers, table, text_slices, tidy

#: Size of a state, bytes of a training window, windows per label, training steps, windows in a step, step size.
HIDDEN, STEPS, PER_LABEL, UPDATES, BATCH, RATE = 8, 96, 512, 240, 128, 0.02
#: Bytes of a stretch, stretches computed side by side, bytes of text handled at once.
STRETCH, LANES, SLICE_BYTES = 128, 2048, 8 << 20
UNKNOWN = "und"
#: A filter rejects texts whose best label has a smaller mean probability.
LEAST_SCORE = 0.4


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(label, window): one window of a hashed document for each of ``PER_LABEL`` buckets of a label."""
    key, length = F.xxhash64("text"), F.length("text")
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang").where(
        F.col("lang").isNotNull() & has_letter(F.col("text"))
    )
    begin = F.pmod(key, F.greatest(length - STEPS, F.lit(0)) + 1) + 1
    sample = (
        learned.select("lang", F.pmod(key, F.lit(PER_LABEL)).alias("bucket"), F.substring("text", begin.cast("int"), F.lit(STEPS)).alias("window"), key.alias("key"))
        .groupBy("lang", "bucket").agg(F.min(F.struct("key", "window")).alias("first"))
    )
    return sorted((r["lang"], r["first"]["window"]) for r in sample.collect())


class Network:
    """Both directions as one stack: weights have a leading axis of two."""

    def __init__(self, labels: list[str], seed: int = 1):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.p = {
            "x": draw.normal(0, 0.3, (2, 256, 3 * HIDDEN)).astype(np.float32),
            "u": draw.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
            "o": draw.normal(0, 0.3, (2, HIDDEN, len(labels))).astype(np.float32),
            "c": np.zeros(len(labels), np.float32),
        }

    def states(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (2, steps, rows, HIDDEN) for bytes (2, steps, rows); ``keep`` collects what the gradient needs.

        Gates are clipped linear functions and the new value is x / (1 + |x|): cheaper than the smooth forms.
        """
        x, u = self.p["x"], self.p["u"]
        _, steps, rows = data.shape
        h = np.zeros((2, rows, HIDDEN), np.float32)
        out = np.empty((2, steps, rows, HIDDEN), np.float32)
        direction = np.arange(2)[:, None]
        for t in range(steps):
            seen, own = x[direction, data[:, t]], h @ u
            gates = seen[..., : 2 * HIDDEN] + own[..., : 2 * HIDDEN]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            update, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
            new = reset * own[..., 2 * HIDDEN :]
            new += seen[..., 2 * HIDDEN :]
            scale = np.abs(new)
            scale += 1
            new /= scale
            if keep is not None:
                keep.append((h, own, gates, new, scale))
            h = new + update * (h - new)
            out[:, t] = h
        return out

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        return forward @ self.p["o"][0] + backward @ self.p["o"][1] + self.p["c"]

    def gradient(self, data: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all positions of rows of bytes (rows, steps), and its gradient by time-reversed passes."""
        rows, steps = data.shape
        flip = np.maximum(sizes[:, None] - 1 - np.arange(steps), 0)
        both = np.stack((data.T, np.take_along_axis(data, flip, 1).T))
        keep: list = []
        h = self.states(both, keep)
        valid = (np.arange(steps)[:, None] < sizes).astype(np.float32)
        row = np.arange(rows)
        aligned = h[1][flip.T, row]
        logits = self.logits(h[0], aligned)
        logits -= logits.max(-1, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(-1, keepdims=True)
        total = valid.sum()
        loss = -(np.log(np.maximum(share[:, row, labels], 1e-12)) * valid).sum() / total
        share[:, row, labels] -= 1
        share *= (valid / total)[..., None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = share.sum((0, 1))
        g["o"] = np.stack([np.einsum("trh,trl->hl", side, share) for side in (h[0], aligned)])
        d_out = np.zeros_like(h)
        d_out[0] = share @ self.p["o"][0].T
        np.add.at(d_out[1], (flip.T, row), share @ self.p["o"][1].T)
        d_h = np.zeros((2, rows, HIDDEN), np.float32)
        direction = np.arange(2)[:, None]
        for t in range(steps - 1, -1, -1):
            before, own, gates, new, scale = keep[t]
            d_h = d_h + d_out[:, t]
            update, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
            d_new = d_h * (1 - update) / (scale * scale)
            d_gates = np.concatenate((d_h * (before - new), d_new * own[..., 2 * HIDDEN :]), -1)
            d_gates *= 0.25 * ((gates > 0) & (gates < 1))
            d_seen = np.concatenate((d_gates, d_new), -1)
            d_own = np.concatenate((d_gates, d_new * reset), -1)
            np.add.at(g["x"], (direction, both[:, t]), d_seen)
            g["u"] += before.transpose(0, 2, 1) @ d_own
            d_h = d_h * update + d_own @ self.p["u"].transpose(0, 2, 1)
        return float(loss), g

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean label probabilities over all bytes of each text; zeros for an empty one."""
        sizes = np.diff(offsets)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = offsets[:-1][owner] + place * STRETCH
        lengths = np.minimum(STRETCH, offsets[1:][owner] - begins)
        sums = np.zeros((len(sizes), len(self.labels)))
        order = np.argsort(-lengths, kind="stable")  # full stretches first, then shorter ones among their like
        padded = np.concatenate((data, np.zeros(STRETCH, np.uint8)))
        for first in range(0, len(order), LANES):
            some = order[first : first + LANES]
            n, steps = lengths[some], int(lengths[some[0]])
            at = begins[some] + np.arange(steps)[:, None]
            flip = np.maximum(n - 1 - np.arange(steps)[:, None], 0)
            both = np.stack((padded[at], padded[begins[some] + flip]))
            h = self.states(both)
            full = int(n[-1]) == steps
            backward = h[1][::-1] if full else h[1][flip, np.arange(len(some))]
            share = np.exp(np.clip(self.logits(h[0], backward), -30, 30))
            share /= share.sum(-1, keepdims=True)
            if not full:
                share *= (np.arange(steps)[:, None] < n)[..., None]
            np.add.at(sums, owner[some], share.sum(0))
        return sums / np.maximum(sizes, 1)[:, None]


def train(sample: list[tuple[str, str]], updates: int = UPDATES, seed: int = 1) -> Network:
    """A network fitted to (label, text) by Adam steps; every step draws as many windows of each label."""
    labels = sorted({label for label, _ in sample})
    net = Network(labels, seed)
    windows = [text.encode()[:STEPS] for _, text in sample]
    sizes = np.array([len(w) for w in windows], np.int64)
    data = np.zeros((len(windows), STEPS), np.uint8)
    for row, window in zip(data, windows):
        row[: len(window)] = np.frombuffer(window, np.uint8)
    target = np.array([labels.index(label) for label, _ in sample], np.int64)
    draw = np.random.default_rng(seed)
    own = [np.flatnonzero(target == k) for k in range(len(labels))]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    if len(labels) > 1:
        for step in range(1, updates + 1):
            some = np.concatenate([draw.choice(rows, -(-BATCH // len(labels))) for rows in own])
            rate = RATE * (1 - (step - 1) / updates)
            _, gradient = net.gradient(data[some], sizes[some], target[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
            for k, g in gradient.items():
                g = g / max(1.0, norm)
                mean, square = moment[k]
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                net.p[k] -= (rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame) -> Network:
    return train(training_sample(docs.select("doc_id", "text", "lang")))


def predict(docs: DataFrame, net: Network, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the two named ones, which replace columns of these names; only the text is looked at."""
    docs = docs.drop(label, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    rows = docs.withColumn("\x00letter", has_letter(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                data, offsets = buffers(part.column(part.schema.get_field_index("text")))
                letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                known = letter & bool(net.labels)
                share = net.probabilities(data, offsets) if net.labels else np.zeros((part.num_rows, 1))
                best = share.argmax(1)
                names = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                scores = np.where(known, np.round(share[np.arange(len(best)), best], 6), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))],
                    names=[*part.schema.names[:-1], label, score],
                )

    return rows.mapInArrow(tidy(run), schema)


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns."""
    found = predict(docs, fit(docs), "\x00label", "\x00score")
    return found.where((F.col("\x00label") != UNKNOWN) & (F.col("\x00score") >= least)).select(*docs.columns)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, tuple[Callable, str | None]] = {"op7_language": (op7_language, None)}
