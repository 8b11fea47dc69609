"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACE, blocks, byte_set, mix64, span_hashes, word_bounds
from .training import held_out, sample

#: Documents learned from at most, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32_768
SLOTS, WIDTH, NONZERO, WINDOW, HIDDEN, STEPS = 1 << 14, 64, 4, 2, 24, 300
CHUNK = 1 << 14

_UPPER = byte_set(bytes(range(65, 91))).astype(np.int32)
_DIGIT = byte_set(b"0123456789").astype(np.int32)
_PUNCT = byte_set(bytes(b for b in range(33, 127) if not chr(b).isalnum())).astype(np.int32)


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each slot, fixed by the slot's number."""
    table = np.zeros((SLOTS, WIDTH), np.float32)
    for k in range(NONZERO):
        bits = mix64(np.arange(SLOTS, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k))
        table[np.arange(SLOTS), (bits % np.uint64(WIDTH)).astype(int)] += np.where(bits >> np.uint64(63), 1, -1)
    return table


def word_slots(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of words and of their shapes (case, digits, closing marks), and first words of rows."""
    starts, ends, first = word_bounds(offsets, data, SPACE)
    words = (span_hashes(data, starts, ends) & np.uint64(SLOTS - 1)).astype(np.int64)

    def inside(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int32)))
        return sums[ends] - sums[starts]

    size, upper, digit, punct = ends - starts, inside(_UPPER), inside(_DIGIT), inside(_PUNCT)
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper + punct >= size, 3, 2)))
    closing = np.where(_PUNCT[data[ends - 1]] > 0, data[ends - 1], 0) if len(ends) else np.zeros(0, np.int64)
    shape = ((case * 2 + (digit > 0)) * 4 + np.minimum(punct, 3)) * 256 + closing
    shapes = (mix64(shape.astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(SLOTS - 1)).astype(np.int64)
    return words, shapes, first


def pooled(vectors: np.ndarray, words: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: mean word vector, mean shape vector, mean likeness of neighbours, log length."""
    n = len(first) - 1
    result = np.zeros((n, 2 * WIDTH + 2), np.float64)
    counts = np.diff(first)
    for at in range(0, len(words), CHUNK):
        end = min(at + CHUNK, len(words))
        low, high = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, end, "left")
        rows = np.arange(low, high)
        rows = rows[counts[rows] > 0]
        cuts = np.maximum(first[rows], at) - at
        w = vectors[words[at:end]]
        result[rows, :WIDTH] += np.add.reduceat(w, cuts, axis=0)
        result[rows, WIDTH : 2 * WIDTH] += np.add.reduceat(vectors[shapes[at:end]], cuts, axis=0)
        follower = vectors[words[min(end, len(words) - 1)]][None]
        alike = np.einsum("ij,ij->i", w, np.concatenate((w[1:], follower)))
        stops = first[1:][rows] - 1 - at
        stops = stops[(stops >= 0) & (stops < end - at)]
        alike[stops] = 0
        result[rows, 2 * WIDTH] += np.add.reduceat(alike, cuts)
    result[:, : 2 * WIDTH + 1] /= np.maximum(counts, 1)[:, None]
    result[:, 2 * WIDTH + 1] = np.log1p(counts)
    return result


@dataclass
class Model:
    """Word vectors, the scaling of pooled features, two layers and a temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        found = [np.empty(0)]
        for _, _, offsets, data in blocks(texts):
            logits = self.logits(pooled(self.vectors, *word_slots(offsets, data)))
            found.append(1 / (1 + np.exp(-np.clip(logits / self.temperature, -50, 50))))
        return np.concatenate(found)


def context_vectors(texts: pa.Array) -> np.ndarray:
    """Unit word vectors: a word's own index vector plus those of its neighbours and shapes."""
    index = index_vectors()
    context = np.zeros((SLOTS, WIDTH), np.float32)
    for _, _, offsets, data in blocks(texts, 1 << 18):
        words, shapes, first = word_slots(offsets, data)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        around = index[shapes].copy()
        for step in range(1, WINDOW + 1):
            if len(words) > step:
                same = (row[step:] == row[:-step])[:, None]
                around[step:] += np.where(same, index[words[:-step]], 0)
                around[:-step] += np.where(same, index[words[step:]], 0)
        if len(words):
            order = np.argsort(words, kind="stable")
            sorted_words = words[order]
            cuts = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1])))
            context[sorted_words[cuts]] += np.add.reduceat(around[order], cuts, axis=0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = index / np.sqrt(NONZERO) + context / np.maximum(norm, 1e-9)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the cross-entropy; the temperature is fitted on a fifth kept from the training."""
    vectors = context_vectors(texts)
    parts = [pooled(vectors, *word_slots(o, d)) for _, _, o, d in blocks(texts)]
    x = np.concatenate(parts) if parts else np.zeros((0, 2 * WIDTH + 2))
    rng = np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        zero = [np.zeros((2 * WIDTH + 2, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])]
        return Model(vectors, np.zeros(2 * WIDTH + 2), np.ones(2 * WIDTH + 2), zero, 1.0)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z, y = (x - centre) / scale, labels.astype(np.float64)
    kept = rng.random(len(y)) < 0.2
    layers = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    a, t = z[~kept], y[~kept]
    for step in range(1, STEPS + 1):
        hidden = np.tanh(a @ layers[0] + layers[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3][0], -50, 50))) - t) / max(len(t), 1)
        back = np.outer(error, layers[2]) * (1 - hidden**2)
        grads = [a.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
        for p, g, (m, v) in zip(layers, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(vectors, centre, scale, layers, 1.0)
    logits, truth = model.logits(x[kept]), y[kept]
    if len(truth):
        options = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, logits / k) - truth * logits / k) for k in options]
        model.temperature = float(options[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Model:
    return fit(*sample(docs, labels, "quality", rows, max_bytes))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each whole text.

    The score is the calibrated probability of quality 1. Null and empty texts
    pool to zero vectors and get the network's score for them. Rows may repeat;
    null ids count as not held out. One pass, no shuffle; the model (4 MB of word
    vectors, fixed by SLOTS * WIDTH) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
