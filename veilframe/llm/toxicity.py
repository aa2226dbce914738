"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of two hashed vectors, one for the word (lower case, without
punctuation around it) and one for its first letters, so that inflected forms share one.
Filters of widths 1, 2 and 3 run over the word sequence; each filter's maximum over the text goes
into a logistic output. All of it is trained in numpy by gradient descent; the maximum passes a
gradient to one place a filter and text. Thresholds are then calibrated by language on all labelled
documents that the descent did not see, counted at the class mix of all labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash, whole_text
from .labelled import fetch, prior_shift, training_rows
from .wordhash import WordRows, sigmoid

BUCKETS = 1 << 15
PREFIX = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 12
EPOCHS = 12
#: Few rows are gone through more often, for at least this many steps in all.
LEAST_STEPS = 600
#: But the extra rounds go over this many words in all at most, so that few long texts take no longer.
MOST_WORDS = 40_000_000
#: At most this many labelled documents are learnt from, half of each class.
TRAIN_ROWS = 4000
THRESHOLD = 0.3
#: A language gets a threshold of its own from this many labelled documents of each class on.
LEAST_FOR_LANGUAGE = 20
#: Score bins for thresholds: so many to a unit of log odds, of which more than 20 count as 20.
BINS = 20
_AROUND = ".,;:!?\"'()[]{}*#$%&|<>-_"


def word_buckets(words: list[str]) -> np.ndarray:
    """Two buckets a word; bucket 0 is kept for the gaps between texts."""
    out = np.empty((len(words), 2), np.int32)
    for i, w in enumerate(words):
        low = (w.strip(_AROUND) or w).lower()
        out[i] = 1 + zlib.crc32(low.encode("utf-8", "surrogatepass")) % (BUCKETS - 1), 1 + zlib.crc32(low[:PREFIX].encode("utf-8", "surrogatepass"), 7) % (BUCKETS - 1)
    return out


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dimensions
    filters: list[np.ndarray]  # by width: width x dimensions x filters
    shift: np.ndarray  # by filter of all widths
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def features(self, ids: np.ndarray, sizes: np.ndarray, places: bool = False):
        """Maxima over each text of each filter; ids of several texts in a row, with their sizes.

        Texts are set apart by gaps as long as the widest filter, so none is too short.
        """
        gap = max(WIDTHS)
        starts = np.cumsum(sizes + gap) - (sizes + gap)
        ends = starts + sizes + 1  # of the windows that begin in the text, or just after it
        padded = np.zeros((int((sizes + gap).sum()) + gap, 2), np.int32)
        if len(ids):
            padded[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * gap, sizes)] = ids
        x = self.embedding[padded[:, 0]] + self.embedding[padded[:, 1]]
        n = len(padded) - gap
        out, where = [], []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            y = x[:n] @ f[0]
            for k in range(1, width):
                y += x[k : n + k] @ f[k]
            top = np.maximum.reduceat(y, np.stack([starts, ends], 1).ravel())[::2]
            out.append(top)
            if places:
                where.append(np.stack([s + y[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)]))
        top = np.concatenate(out, 1) + self.shift
        return (top, np.concatenate(where, 1), padded) if places else top

    def margin(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.maximum(self.features(ids, sizes), 0) @ self.weights + self.bias


def new_model(seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embedding[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    return Model(embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.2, n).astype(np.float32), 0.0)


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS, rate: float = 2.0, drop: float = 0.3, decay: float = 1e-3) -> Model:
    """Minibatch gradient descent.

    Embeddings move at one constant rate, so that words which many toxic texts share move far and
    words of a single text hardly; words are dropped at random for the same reason.
    """
    model, rng = new_model(seed), np.random.default_rng(seed + 1)
    seen_f = [np.full_like(f, 1e-2) for f in model.filters]
    seen_w, seen_s, seen_b = np.full_like(model.weights, 1e-2), np.full_like(model.shift, 1e-2), 1e-2
    epochs = max(epochs, min(-(-LEAST_STEPS * 32 // len(texts)), MOST_WORDS // max(1, sum(map(len, texts)))))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            words = [texts[k][rng.random(len(texts[k])) >= drop] for k in batch]
            top, places, padded = model.features(np.concatenate(words), np.array([len(w) for w in words]), True)
            on = np.maximum(top, 0)
            error = (sigmoid(on @ model.weights + model.bias) - labels[batch]).astype(np.float32)
            back = error[:, None] * model.weights * (top > 0)
            d_weights, d_bias, d_shift = error @ on + decay * model.weights, float(error.sum()), back.sum(0)
            touched, moved = [], []
            for w, width in enumerate(WIDTHS):
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                grad = decay * model.filters[w]
                for k in range(width):
                    ids = padded[places[:, cols] + k]  # texts x filters x 2
                    x = model.embedding[ids[..., 0]] + model.embedding[ids[..., 1]]
                    grad[k] += np.einsum("bf,bfd->df", back[:, cols], x)
                    to_word = back[:, cols, None] * model.filters[w][k].T[None]
                    for half in (0, 1):
                        touched.append(ids[..., half].ravel())
                        moved.append(to_word.reshape(-1, DIMENSIONS))
                seen_f[w] += grad**2
                model.filters[w] -= 0.05 * grad / np.sqrt(seen_f[w])
            used, place = np.unique(np.concatenate(touched), return_inverse=True)
            moved_all = np.concatenate(moved)
            grad = np.stack([np.bincount(place, moved_all[:, d], len(used)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            grad[used == 0] = 0
            model.embedding[used] -= step * grad / 32
            seen_w += d_weights**2
            seen_s += d_shift**2
            seen_b += d_bias**2
            model.weights -= 0.05 * d_weights / np.sqrt(seen_w)
            model.shift -= 0.05 * d_shift / np.sqrt(seen_s)
            model.bias -= 0.05 * d_bias / np.sqrt(seen_b)
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best F1 plateau's edge: half way between the neighbours of the best cut."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(s[1:] != s[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def _sequences(texts: DataFrame) -> DataFrame:
    """t_id, label and ``data``: the words' buckets as int32, two after each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows(word_buckets)
        for batch in batches:
            cells = [rows.rows[numbers].tobytes() for chunk in rows.chunks(batch.column(2).to_pylist()) for numbers in chunk]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["t_id", "label", "data"])

    return texts.select("t_id", "label", "text").mapInArrow(run, "t_id long, label int, data binary")


def fitted(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int) -> tuple[Model, DataFrame, set[int] | None]:
    """A model without thresholds, the labels it may use, and the ids it learnt from (null: none)."""
    usable = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    back = F.pmod(F.xxhash64("doc_id", F.lit("threshold")), F.lit(5)) == 4
    some = usable.count() >= 50  # of fewer, none is held back
    texts, counts = training_rows(docs, labels, "toxic", may_learn & ~back if some else may_learn, rows)
    shift = prior_shift(counts)
    got = fetch(texts, _sequences)
    if len(set(got.labels.tolist())) < 2:
        model = new_model()
        model.weights[:] = 0
        model.bias = shift
        return model, usable, None
    model = fit([np.frombuffer(got.row(k).tobytes(), np.int32).reshape(-1, 2) for k in range(len(got.ids))], got.labels)
    model.bias += prior_shift(counts, got.labels.tolist())
    return model, usable, set(got.ids)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.toxic``; without rows of both classes, one that gives the prior."""
    model, usable, ids = fitted(docs, labels, may_learn, rows)
    if ids is not None:
        model.thresholds = thresholds(_scores(docs, model), usable, ids)
    return model


def judge(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """As :func:`score` of ``docs`` by the model of :func:`train`, with every text scored once.

    Scores are written, and both thresholds and ``flagged`` come from that table.
    """
    model, usable, ids = fitted(docs, labels, may_learn, rows)
    scores = stash(_scores(docs, model).drop("flagged"))
    limits = thresholds(scores, usable, ids) if ids is not None else {}
    named = docs.sparkSession.createDataFrame([(k, v) for k, v in limits.items() if k], "t_lang string, t_limit double")  # a row a language
    limit = F.coalesce("t_limit", F.lit(limits.get("", THRESHOLD)))
    return scores.join(F.broadcast(named), F.col("lang") == F.col("t_lang"), "left").select("doc_id", "score", (F.col("score") >= limit).alias("flagged"))


def thresholds(scores: DataFrame, labels: DataFrame, fitted: set[int]) -> dict[str, float]:
    """Thresholds by language, and for all others under ''.

    Only ``scores`` (doc_id, lang, score) meet the labels. Rows of ``fitted``
    (bounded) count for the class mix alone. A language with fewer than ``LEAST_FOR_LANGUAGE``
    other rows of a class goes into '' before its counts come to the driver.
    """
    spark = scores.sparkSession
    seen = spark.createDataFrame([(i,) for i in sorted(fitted)], "f_id long").withColumn("fitted", F.lit(True))
    truth = labels.select(F.col("doc_id").cast("long").alias("t_id"), F.col("toxic").cast("int").alias("label"))
    odds = F.ln(F.col("score") / (1 - F.col("score")))
    at = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), odds)) * BINS).cast("int")
    rows = scores.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), at.alias("bin"))
    rows = rows.join(truth, F.col("doc_id") == F.col("t_id")).join(F.broadcast(seen), F.col("doc_id") == F.col("f_id"), "left")
    fresh = F.sum(F.when(F.col("fitted").isNull(), 1).otherwise(0))
    counts = rows.groupBy("lang", "label", "bin").agg(F.count("*").alias("n"), fresh.alias("fresh"))
    whole = Window.partitionBy("lang")  # bounded by the bins
    rarer = F.least(*(F.sum(F.when(F.col("label") == k, F.col("fresh")).otherwise(0)).over(whole) for k in (0, 1)))
    named = counts.withColumn("lang", F.when(rarer >= LEAST_FOR_LANGUAGE, F.col("lang")).otherwise(""))
    found = named.groupBy("lang", "label", "bin").agg(F.sum("n").alias("n"), F.sum("fresh").alias("fresh")).collect()
    out = {}
    for name in {r["lang"] for r in found} | {""}:
        limit = best_cut([(r["bin"], r["label"], r["n"], r["fresh"]) for r in found if name in ("", r["lang"])])
        if limit is not None:
            out[name] = limit
    return out


def best_cut(counts: list[tuple[int, int, int, int]]) -> float | None:
    """The score of best F1, from (bin, label, n, fresh) counts: scores fresh, class mix of n.

    A class without fresh rows is measured on all its rows. The cut is the middle of the gap below
    the last bin that counts as toxic; without both classes there is none.
    """
    n = [sum(c[2] for c in counts if c[1] == k) for k in (0, 1)]
    new = [sum(c[3] for c in counts if c[1] == k) for k in (0, 1)]
    if not min(n):
        return None
    bins: dict[int, list[float]] = {}
    for b, k, all_, fresh in counts:
        if weight := fresh * n[k] / new[k] if new[k] else float(all_):
            bins.setdefault(b, [0.0, 0.0])[k] += weight
    order = sorted(bins, reverse=True)
    hits = np.cumsum([bins[b][1] for b in order])
    taken = np.cumsum([sum(bins[b]) for b in order])
    k = int(np.argmax(2 * hits / (taken + n[1])))
    below = order[k + 1] + 1 if k + 1 < len(order) else order[k]
    return float(sigmoid((order[k] + below) / 2 / BINS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and whether the score reaches the threshold of the document's language.

    Null and empty texts get the score of no words. ``lang`` never enters the score.
    """
    return _scores(docs, model).drop("lang")


def _scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score, flagged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = shared.value, WordRows(word_buckets)
        other = model.thresholds.get("", THRESHOLD)
        for batch in batches:
            scores = []
            for chunk in rows.chunks(batch.column(1).to_pylist()):
                at = 0
                while at < len(chunk):  # about 200,000 words together
                    part, size = [], 0
                    while at < len(chunk) and size < 200_000:
                        part.append(chunk[at])
                        size += len(chunk[at])
                        at += 1
                    ids = rows.rows[np.concatenate(part)]
                    scores.append(sigmoid(model.margin(ids, np.array([len(p) for p in part]))))
            s = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            limit = np.array([model.thresholds.get(x, other) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array(s >= limit, pa.bool_())], names=["doc_id", "lang", "score", "flagged"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), lang.alias("lang")).mapInArrow(run, "doc_id long, lang string, score double, flagged boolean")
