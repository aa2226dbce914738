from collections import Counter

import corpus_pipeline
from test_neardup import brute

from veilframe.llm import mixing, quality, secrets

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from pyspark.sql import functions as F

    start = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        seen.append(docs.collect())
        assert docs.columns == start.columns or len(seen) == len(corpus_pipeline.STAGES)
    good, unique, masked, mixed, packed = seen
    first = {r["doc_id"]: r for r in start.collect()}
    model = quality.train(start, spark.read.parquet(f"{DATA}/labels.parquet"), F.lit(True))
    want = {r["doc_id"] for r in quality.score(start, model).collect() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good} == want and all(r == first[r["doc_id"]] for r in good)
    classes = brute([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"] for r in unique} == set(classes.values())
    cost = secrets.GuessCost()
    for r in masked:
        base, more, _ = secrets.scan(first[r["doc_id"]]["text"], cost)
        assert r["text"] == secrets.redacted(first[r["doc_id"]]["text"], base + more) and r["n_chars"] == len(r["text"])
    assert Counter(r["doc_id"] for r in masked) == Counter(r["doc_id"] for r in unique)
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in masked}
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= mixing.REPETITIONS
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 2048


def test_the_driver_gives_memory_back_before_each_stage(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(corpus_pipeline, "give_back", freed.append)
    for _, stage in corpus_pipeline.STAGES:
        n = len(freed)
        try:
            stage(spark, None, "")
        except Exception:  # noqa: S110 - there are no documents here
            pass
        assert len(freed) == n + 1
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
