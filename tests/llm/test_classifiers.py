import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import labelled, quality, queries, toxicity
from veilframe.llm.common import held_out
from veilframe.llm.wordhash import WordRows, ngram_buckets

DATA = "/root/testdata/sf0.1"


def outcome(spark, got, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select(F.col("doc_id").alias("i"), label)
    rows = got.where("held_out").join(labels, F.col("doc_id") == F.col("i")).groupBy(label, "predicted").count().collect()
    return {(r[label], r["predicted"]): r["count"] for r in rows}


def test_quality_on_held_out_rows(spark):
    n = outcome(spark, queries.op4_quality(spark, DATA), "quality")
    assert n.get((0, 0), 0) >= 0.85 * (n.get((0, 0), 0) + n.get((0, 1), 0))
    assert n.get((1, 0), 0) <= 0.01 * n[1, 1]


def test_toxicity_on_held_out_rows(spark):
    n = outcome(spark, queries.op10_toxicity(spark, DATA), "toxic")
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.03 * n[0, 0]


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edges(spark, op):
    texts = [None, "", "good clean prose " * 10, "!!" * 20_000, "word " * 60_000, "\ud7ff é"]
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)] + [(2, texts[2], "en", 1)], "doc_id long, text string, lang string, score int")
    name = "quality" if op is quality else "toxic"
    labels = spark.createDataFrame([(2, 1, "x"), (3, 0, "x"), (2, 1, "x"), (None, 1, "x"), (4, None, "x"), (5, 7, "x")], f"doc_id long, {name} int, text string")
    for rows in (labels, labels.limit(0), labels.where("doc_id = 2")):
        model = op.train(docs, rows, F.lit(True))
        got = op.score(docs, model).collect()
        assert len(got) == len(texts) + 1 and all(0 <= r["score"] <= 1 for r in got)
        by = {r["doc_id"]: r["score"] for r in got}
        assert by[0] == by[1]
        assert op.score(docs.limit(0), model).collect() == []
    model = op.train(docs.limit(0), labels, F.lit(True))
    assert len(op.score(docs, model).collect()) == len(texts) + 1


def test_quality_score_is_the_network(spark):
    """Adding margins word by word equals averaging the vectors of all tokens."""
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS + 2), 0.3)
    text = "Aber, die the The the die the The x"
    tokens = [b for w in text.split() for b in ngram_buckets(w, quality.SIZES, quality.BUCKETS)]
    pairs = list(zip(text.split(), text.split()[1:], strict=False))
    new = len(set(pairs))
    tokens += [quality.NEW_PAIR] * new + [quality.OLD_PAIR] * (len(pairs) - new)
    want = 1 / (1 + np.exp(-(model.margin[tokens].mean() + 0.3)))
    assert abs(quality.Scorer(model.margin, model.bias)([text])[0] - want) < 1e-12
    docs = spark.createDataFrame([(1, text, 0)], "t_id long, text string, label int")
    buckets, counts = quality.unpacked(np.frombuffer(quality.bags(docs).first()["data"], np.uint8))
    assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == {b: tokens.count(b) for b in set(tokens)}


def test_fitting_sample_is_bounded(spark):
    """One row an id, of each class as many whole rows as fit; a huge row does not bar those after it."""
    texts = [(i % 50, "abcdef ghijkl " * (4000 if i == 3 else 1) + f"w{i % 50}", i % 2) for i in range(100)]
    docs = spark.createDataFrame(texts, "t_id long, text string, label int")
    whole = labelled.fetch(docs, toxicity._sequences)
    assert whole.ids == list(range(50)) and whole.labels.tolist() == [i % 2 for i in range(50)]
    assert len(whole.row(3)) == 8 * 8001 and len(whole.data) == sum(len(whole.row(k)) for k in range(50))
    some = labelled.fetch(docs, toxicity._sequences, most_bytes=2 * 10 * 24)
    assert len(some.ids) == 20 and 3 not in some.ids and sum(some.labels) == 10
    for k, i in enumerate(some.ids):
        assert bytes(some.row(k)) == bytes(whole.row(i))
    assert labelled.fetch(docs.limit(0), toxicity._sequences).ids == []


def test_convolution_is_plain():
    rng = random.Random(1)
    model = toxicity.new_model(4)
    model.embedding[1:] = np.random.default_rng(5).normal(size=model.embedding[1:].shape)
    texts = [[], ["a"], ["a", "b"], [rng.choice("abcdefg") for _ in range(30)]]
    rows = WordRows(toxicity.word_buckets)
    ids = [rows.rows[n] if len(n) else np.zeros((0, 2), np.int32) for chunk in rows.chunks([" ".join(t) for t in texts]) for n in chunk]
    got = model.features(np.concatenate(ids), np.array([len(t) for t in texts]))
    for row, t in zip(got, ids, strict=True):
        gap = np.zeros((3, toxicity.DIMENSIONS))
        x = np.concatenate([model.embedding[t].sum(1) if len(t) else gap[:0], gap, gap])
        want = [max(sum(x[i + k] @ f[k][:, j] for k in range(w)) for i in range(len(t) + 1)) for w, f in zip(toxicity.WIDTHS, model.filters, strict=True) for j in range(toxicity.FILTERS)]
        assert np.allclose(row, want, atol=1e-4)


def test_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.6)


def test_held_out(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_cut_at_the_true_class_mix():
    """Few fresh toxic rows stand for all toxic ones; fitted rows give the class mix alone."""
    counts = [(40, 1, 50, 10), (10, 1, 50, 10), (10, 0, 900, 400), (-40, 0, 100, 100)]
    assert toxicity.best_cut(counts) == pytest.approx(1 / (1 + np.exp(-(40 + 11) / 2 / toxicity.BINS)))
    assert toxicity.best_cut([(40, 1, 9, 0), (-40, 0, 9, 9)]) == pytest.approx(1 / (1 + np.exp(-(40 - 39) / 2 / toxicity.BINS)))
    assert toxicity.best_cut([(1, 0, 5, 5)]) is None


def test_thresholds_use_labels_outside_the_sample(spark):
    """A language of 2 % has a threshold of its own, though the fitting sample holds few of its rows."""
    rows = [(i, ("vile brute " if i % 8 == 0 else "calm prose ") * 4 + f"w{i % 97}", "xx" if i % 50 < 1 or i % 50 == 8 else "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), rows=200)
    assert set(model.thresholds) == {"", "en", "xx"}
    wrong = toxicity.score(docs, model).where(F.col("flagged") != (F.col("doc_id") % 8 == 0))
    assert wrong.count() == 0


def test_few_long_rows_take_bounded_time():
    import time

    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 30_000, (n, 2)).astype(np.int32) for n in (400_000, 10, 20, 30, 5)]
    began = time.perf_counter()
    toxicity.fit(texts, np.array([0, 1, 0, 1, 0]))
    assert time.perf_counter() - began < 60


def test_toxicity_scored_once_equals_a_trained_model(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learn = ~held_out(F.col("doc_id"), 4, 2)
    want = toxicity.score(docs, toxicity.train(docs, labels, learn)).collect()
    got = toxicity.judge(docs.withColumn("t_lang", F.lit("x")), labels, learn).collect()
    show = lambda rows: sorted((r["doc_id"], r["score"], r["flagged"]) for r in rows)
    assert show(got) == show(want)
