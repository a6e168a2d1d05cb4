"""Operator 1: document quality by gated attention over passages.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from its
hashed byte trigrams and a few shape measures by a learned layer; gated attention weighs
the encoded passages, and the weighted sum is scored. Encoder, gates and score are learned
together from document labels (multiple-instance learning), by plain gradient steps over
a bounded sample of labelled rows: at most ``sample`` documents and ``sample_bytes`` of
passages, taken by the order of a hash of their id. A labelled text of any length can be
drawn; it is learned from by all its passages, or by ``BAG`` of them, evenly spaced over the
whole text, if it has more. Scoring reads every passage of every text; a score depends on
nothing but the model and the text.

Defined results: null and empty texts are one empty passage and get that bag's score; an
empty table gives an empty result; without two classes among the labels every score is the
share of good labels (0.5 if there are none) and ``keep`` keeps every row. Repeated label rows count once for each
different label; labels that are null are skipped. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint, held_out, let_go, slices, small_batches, utf8

PASSAGE = 512
TRIGRAMS = 256
SHAPES = 10
FEATURES = TRIGRAMS + SHAPES
SAMPLE = 6000
#: Most bytes of passages in the sample.
SAMPLE_BYTES = 64 << 20
#: Most passages of one labelled text that the fit learns from.
BAG = 2048
THRESHOLD = 0.7
_ODD = np.random.default_rng(5).integers(1 << 62, size=(4, 256), dtype=np.uint64) | np.uint64(1)


def passages_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a slice of texts, and each text's first passage. A
    passage's features depend on its own bytes only."""
    lengths = np.diff(offsets)
    each = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    n = int(first[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        return out, first
    inside = np.arange(len(raw)) - np.repeat(offsets[:-1], lengths)
    passage = np.repeat(first[:-1], lengths) + inside // PASSAGE
    size = np.bincount(passage, minlength=n).astype(np.float32)
    size[size == 0] = 1
    whole = passage[2:] == passage[:-2]
    grams = (_ODD[0][raw[:-2]] + _ODD[1][raw[1:-1]] + _ODD[2][raw[2:]])[whole]
    bucket = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
    out[:, :TRIGRAMS] = np.sqrt(np.bincount(passage[:-2][whole] * TRIGRAMS + bucket, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / size[:, None])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    upper, lower, digit = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
    mark = ~(blank | upper | lower | digit) & (raw < 128)
    share = lambda mask: np.bincount(passage, mask, n) / size
    shape = [share(upper), share(digit), share(mark), share(blank), share(raw == 10) * 10, share(raw >= 128)]
    begins = ~blank
    begins[1:] &= blank[:-1] | (passage[1:] != passage[:-1])
    at = np.flatnonzero(begins)
    words = np.zeros(n)
    repeated, distinct, length = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(at):
        place = np.arange(at[0], len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
        value = np.where(blank[at[0] :], 0, _ODD[3][raw[at[0] :]] * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)))
        hashed = np.add.reduceat(value, at - at[0])
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        of = passage[at]
        words = np.bincount(of, minlength=n)
        same = np.zeros(len(at), bool)
        same[1:] = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        repeated = np.bincount(of, same, n)
        seen = np.unique(of.astype(np.uint64) << np.uint64(36) | hashed >> np.uint64(28))
        distinct = np.bincount((seen >> np.uint64(36)).astype(np.int64), minlength=n)
        length = np.bincount(passage, ~blank, n) / np.maximum(words, 1) / 10
    many = np.maximum(words, 1)
    shape += [repeated / many, distinct / many, length, words / size * 5]
    out[:, TRIGRAMS:] = np.stack(shape, axis=1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """The model; ``p`` holds its arrays."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"W": normal(FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": normal(hidden, gate), "U": normal(hidden, gate), "w": normal(gate), "c": normal(hidden), "c0": np.zeros(1, np.float32)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), None

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, starts, bag = self.p, first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raised = (t * s) @ p["w"]
        raised = np.exp(raised - np.maximum.reduceat(raised, starts)[bag])
        a = raised / np.add.reduceat(raised, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return bag, h, t, s, a, z, _sigmoid(z @ p["c"] + p["c0"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        x = np.clip((x - self.mean) * self.scale, -5, 5).astype(np.float64)
        # matrix products may differ in their last bits with the number of rows
        return np.round(self._forward(x, first)[-1], 6)

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> GatedAttention:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean = x.mean(axis=0)
        self.scale = (1 / (x.std(axis=0) + 1e-3)).astype(np.float32)
        x = np.clip((x - self.mean) * self.scale, -5, 5)
        rng, step = np.random.default_rng(11), 0
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), batch):
                bags = order[i : i + batch]
                rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
                starts = np.concatenate([[0], np.cumsum(first[bags + 1] - first[bags])])
                step += 1
                now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
                for k, g in self._gradients(x[rows], starts, y[bags]).items():
                    g = g + decay * self.p[k]
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.99 * two[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        bag, h, t, s, a, z, score = self._forward(x, first)
        wrong = ((score - y) / len(y)).astype(np.float32)
        dz = wrong[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
        gate = ds[:, None] * p["w"]
        dt, dg = gate * s * (1 - t * t), gate * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * s).T @ ds, "c": z.T @ wrong, "c0": wrong.sum(keepdims=True)}


def _spaced(raw: np.ndarray, bag: int) -> np.ndarray:
    """The bytes of at most ``bag`` whole passages of a text, evenly spaced from its first to its last."""
    n = len(raw) // PASSAGE
    if -(-len(raw) // PASSAGE) <= bag:
        return raw
    return raw[: n * PASSAGE].reshape(n, PASSAGE)[np.arange(bag) * (n - 1) // max(1, bag - 1)].reshape(-1)


def _encode_sample(batches: Iterator[pa.RecordBatch], bag: int = BAG) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column(2))
        rows = [passages_of(text, np.array([0, len(text)]))[0].astype(np.float16).tobytes() for text in (_spaced(raw[a:b], bag) for a, b in zip(offsets[:-1], offsets[1:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "quality", "passages"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> GatedAttention:
    """A model of labels.quality, from a bounded sample of labelled rows: the first ``sample``
    by a hash of the id, of these as many as fill ``sample_bytes`` with their passages. Texts
    are chosen by their sizes and fetched afterwards, so none is sorted."""
    small_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .dropDuplicates()
        .orderBy(*order)
        .limit(sample)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    sized = texts.withColumn("size", F.least(F.octet_length("text"), F.lit(BAG * PASSAGE)).cast("long")).drop("text").join(F.broadcast(chosen), "doc_id")
    # of an id's several texts one is learned from
    sized = sized.groupBy("doc_id", "quality").agg(F.min(F.struct("key", "size")).alias("one")).select("doc_id", "quality", "one.*")
    sized = sized.withColumn("until", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    drawn = checkpoint(sized.filter(F.col("until") <= sample_bytes).select("doc_id", "quality", "key"))
    encoded = texts.join(F.broadcast(drawn), ["doc_id", "key"]).select("doc_id", "quality", "text").mapInArrow(_encode_sample, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, passages binary")
    found = encoded.groupBy("doc_id", "quality").agg(F.min("passages").alias("passages")).orderBy(*order).select("passages", "quality").collect()
    bags = [np.frombuffer(r[0], np.float16).reshape(-1, FEATURES) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, FEATURES), np.float32)
    return GatedAttention().fit(x, first, np.array([r[1] for r in found], np.float32))


def score(docs: DataFrame, model: GatedAttention, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least ``threshold``) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            parts = []
            for start, end in slices(offsets):
                parts.append(model.score(*passages_of(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])))
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        let_go()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Learns from labelled rows that are not held out, then scores every row."""
    return score(docs, fit(docs.filter(~held_out()), labels.filter(~held_out()), sample), threshold)


def keep(docs: DataFrame, model: GatedAttention, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns;
    all rows, if the model has seen no two classes and so rejects nothing."""
    if model.constant is not None:
        return docs
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(place))
            scores = [model.score(*passages_of(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])) for start, end in slices(offsets)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))
        let_go()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
