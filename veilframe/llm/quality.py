"""Quality classifier: learned subword embeddings, averaged per document, with a softmax on top.

A word stands for hashed buckets: itself and its character 3- and 4-grams, case and punctuation
included. Two further tokens stand for word pairs that are new in the text and that came before.
Each bucket has a learned vector; a document is the mean over all its tokens' vectors; a softmax
over two classes follows. Vectors and softmax are trained together by minibatch gradient descent
in numpy, on a bounded sample of labelled documents whose sparse token counts are made on the
executors.

Once trained, a bucket matters only by its margin (vector times the difference of the class
weights), so scoring adds up one number a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim, whole_text
from .labelled import fetch, prior_shift, training_rows
from .wordhash import WordRows, ngram_buckets, sigmoid

BUCKETS = 1 << 16
SIZES = (3, 4)
#: At most this many labelled documents are learnt from, half of each class.
TRAIN_ROWS = 4000
DIMENSIONS = 8
EPOCHS = 5
#: Buckets of the two tokens for word pairs.
NEW_PAIR, OLD_PAIR = BUCKETS, BUCKETS + 1
THRESHOLD = 0.3


def pairs(numbers: np.ndarray) -> tuple[int, int]:
    """How many adjacent word pairs are new in a text, and how many came before."""
    n = len(numbers) - 1
    if n < 1:
        return 0, 0
    seen = len(np.unique(numbers[:-1] << 32 | numbers[1:]))
    return seen, n - seen


def _bucket_rows(words: list[str]) -> np.ndarray:
    out = np.empty(len(words), object)
    for i, w in enumerate(words):
        out[i] = np.array(ngram_buckets(w, SIZES, BUCKETS), np.int32)
    return out


def bags(texts: DataFrame) -> DataFrame:
    """t_id, label and ``data``: the token counts of a text as int32 buckets, then float32 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows(_bucket_rows)
        for batch in batches:
            cells = []
            for chunk in rows.chunks(batch.column(2).to_pylist()):
                for numbers in chunk:
                    words, n = np.unique(numbers, return_counts=True)
                    made = [rows.rows[w] for w in words]
                    new, old = pairs(numbers)
                    bag = np.bincount(
                        np.concatenate([*made, [NEW_PAIR, OLD_PAIR]]).astype(np.int64),
                        np.concatenate([*(np.full(len(m), k) for m, k in zip(made, n, strict=True)), [new, old]]),
                    )
                    used = np.flatnonzero(bag)
                    cells.append(used.astype(np.int32).tobytes() + bag[used].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["t_id", "label", "data"])

    return texts.select("t_id", "label", "text").mapInArrow(run, "t_id long, label int, data binary")


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a row of :func:`bags`."""
    half = len(data) // 2
    return np.frombuffer(data[:half].tobytes(), np.int32), np.frombuffer(data[half:].tobytes(), np.float32)


@dataclass
class Model:
    margin: np.ndarray  # by bucket
    bias: float

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sigmoid(total / np.maximum(n, 1) + self.bias)


def fit(buckets: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS, rate: float = 0.5) -> Model:
    """Vectors and softmax by adaptive-rate stochastic gradient descent on minibatches."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS + 2, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full((BUCKETS + 2, 1), 1e-6, np.float32)
    seen_w, seen_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    size = np.array([max(c.sum(), 1.0) for c in counts], np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            batch = [k for k in order[at : at + 32] if len(buckets[k])]
            if not batch:
                continue
            ids = np.concatenate([buckets[k] for k in batch])
            share = np.concatenate([counts[k] / size[k] for k in batch])[:, None]
            starts = np.cumsum([0] + [len(buckets[k]) for k in batch[:-1]])
            docs = np.add.reduceat(vectors[ids] * share, starts)
            logits = docs @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            back = np.repeat(p @ weights.T, [len(buckets[k]) for k in batch], 0) * share
            used, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, back[:, d], len(used)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            seen[used] += (grad**2).mean(1, keepdims=True)
            vectors[used] -= rate * grad / np.sqrt(seen[used])
            for value, g, s in ((weights, docs.T @ p, seen_w), (bias, p.sum(0), seen_b)):
                s += g**2
                value -= 0.1 * g / np.sqrt(s)
    return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality``; without rows of both classes, one that gives the prior."""
    texts, counts = training_rows(docs, labels, "quality", may_learn, rows)
    shift = prior_shift(counts)
    if not counts.get(0) or not counts.get(1):
        return Model(np.zeros(BUCKETS + 2), shift)
    got = fetch(texts, bags)
    if len(set(got.labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS + 2), shift)
    buckets, weights = zip(*(unpacked(got.row(k)) for k in range(len(got.ids))), strict=True)
    model = fit(buckets, weights, got.labels)
    model.bias += prior_shift(counts, got.labels.tolist())
    return model


class Scorer:
    """Scores texts under a model, remembering what each word adds."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.model = Model(margin, bias)
        self.rows = WordRows(self._make)

    def _make(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), 2))
        for i, w in enumerate(words):
            ids = ngram_buckets(w, SIZES, BUCKETS)
            out[i] = self.model.margin[ids].sum(), len(ids)
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        margin, totals, sizes = self.model.margin, [], []
        for chunk in self.rows.chunks(texts):
            for numbers in chunk:
                new, old = pairs(numbers)
                total, n = self.rows.rows[numbers].sum(0) if len(numbers) else (0.0, 0)
                totals.append(total + new * margin[NEW_PAIR] + old * margin[OLD_PAIR])
                sizes.append(n + new + old)
        return self.model.score(np.array(totals, float), np.array(sizes, float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, as they are, whose text (null: empty) scores at least ``least``."""
    schema, shared = docs.schema, docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(scorer(texts) >= least, pa.bool_()))
        del scorer
        trim()

    return docs.mapInArrow(run, schema)
