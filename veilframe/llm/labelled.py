"""Bounded, labelled training rows for the classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_text

#: A fitting sample brings at most so many bytes of features to the driver; whole rows are taken
#: in order of the hash of their id as long as they fit.
TRAIN_BYTES = 48 << 20


@dataclass
class Sample:
    """Rows of a fitting sample in order of id, with their features end to end in one buffer."""

    ids: list[int]
    labels: np.ndarray
    offsets: np.ndarray  # in bytes, one more than rows
    data: np.ndarray  # of bytes

    def row(self, k: int) -> np.ndarray:
        return self.data[self.offsets[k] : self.offsets[k + 1]]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Of at most ``rows`` labelled documents, half of each class: t_id, text and label; and class counts.

    ``train`` says, of a label row, whether it may be learnt from. Null ids, labels other than 0
    and 1, and labels without a document give nothing; an id that is labelled twice counts by its
    first row. The ids taken are the first by a hash, so that any order of the table gives the
    same model; only they, of which there are ``rows`` at most, are broadcast.
    """
    usable = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("t_id"), F.col(label).cast("int").alias("t_label"))
    counts = {r["t_label"]: r["n"] for r in usable.groupBy("t_label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("t_id"), "t_id"]
    taken = [usable.where(F.col("t_label") == k).orderBy(*order).limit(rows // 2) for k in (0, 1)]
    ids = taken[0].unionByName(taken[1]).groupBy("t_id").agg(F.min("t_label").alias("t_label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("d_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(ids), F.col("d_id") == F.col("t_id")).select("t_id", "text", F.col("t_label").alias("label")), counts


def fetch(texts: DataFrame, features: Callable[[DataFrame], DataFrame], most_bytes: int = TRAIN_BYTES) -> Sample:
    """The features of training rows, of ``most_bytes`` at most, as flat arrays.

    ``features`` turns t_id, text, label into t_id, label, data (binary). Rows of one id count
    once, by the least ``data``. They are written once; the driver reads their sizes, takes
    rows of each class in turn while they fit, and then gets the bytes of those, as Arrow.
    """
    made = stash(features(texts).groupBy("t_id").agg(F.min("label").alias("label"), F.min("data").alias("data")))
    sizes = made.select("t_id", "label", F.octet_length("data").alias("n"), F.xxhash64("t_id").alias("h")).collect()
    left, taken = [most_bytes // 2] * 2, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["t_id"])):
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            taken.append((r["t_id"],))
    chosen = made.sparkSession.createDataFrame(taken, "c_id long")
    got = made.join(F.broadcast(chosen), F.col("t_id") == F.col("c_id")).select("t_id", "label", "data").toArrow().combine_chunks().sort_by("t_id")
    ids = got["t_id"].to_pylist()
    cells = [c for c in got["data"].chunks if len(c)]
    data = [np.frombuffer(c.buffers()[2], np.uint8)[_offset(c, 0) : _offset(c, len(c))] for c in cells]
    sizes = {r["t_id"]: r["n"] for r in sizes}
    return Sample(ids, np.array(got["label"].to_pylist(), np.int64), np.cumsum([0, *(sizes[i] for i in ids)]), np.concatenate(data) if data else np.zeros(0, np.uint8))


def _offset(cells, k: int) -> int:
    """Where cell ``k`` of a binary Arrow array begins in its buffer."""
    return int(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset + k])


def prior_shift(counts: dict[int, int], taken: list[int] = ()) -> float:
    """What to add to the log odds of class 1, if ``taken`` labels were learnt from instead of all."""
    ones = sum(taken)
    sampled = math.log((ones + 1) / (len(taken) - ones + 1)) if len(taken) else 0.0
    return math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)) - sampled
