import random
from collections import Counter

import numpy as np

from veilframe.llm import components, neardup, queries


def similarity(a, b):
    def bag(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    whole = sum((x | y).values())
    return sum((x & y).values()) / whole if whole else 0.0


def brute(texts):
    """Least id of each component of links of similarity 0.8 or more."""
    root = {d: d for d, _ in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, t) in enumerate(texts):
        for e, u in texts[:i]:
            if similarity(t, u) >= 0.8:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in texts}


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = [None, "", " \n", "one two", "one two", "one  two", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.4 else base  # chains of copies of copies
    line = " ".join(word() for _ in range(8))
    texts += [(line + "\n") * k for k in (10, 11, 30)]  # multisets differ where sets agree
    return list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))


def test_against_brute_force(spark):
    for seed in range(2):
        texts = made(seed)
        docs = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, n long")
        got = {r["doc_id"]: r for r in neardup.classes(docs).collect()}
        want = brute(texts)
        assert {d: r["class_id"] for d, r in got.items()} == want
        size = Counter(want.values())
        assert all(r["class_size"] == size[r["class_id"]] for r in got.values())
        kept = {r["doc_id"] for r in neardup.deduplicated(docs).collect()}
        assert kept == set(want.values())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for most in (1, 4, 60):
        guess, true = [], []
        for _ in range(30):
            u = np.unique(rng.integers(0, 2**62, 200).astype(np.uint64))
            c = rng.integers(1, most + 1, len(u))
            k = rng.random(len(u)) < 0.85
            a, b = (u, c), (u[k], np.maximum(1, c + rng.integers(-(most // 3), most // 3 + 1, len(u)))[k])
            s = neardup.signatures([a, b])
            guess.append((s[0] == s[1]).mean())
            true.append(neardup.similarity(a, b))
        assert abs(np.mean(guess) - np.mean(true)) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 150, 150: 150}


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(docs).collect())) == [(1, 1, 2), (1, 1, 2), (2, 2, 1)]
    assert neardup.classes(docs.limit(0)).collect() == []


def test_chains_and_groups_without_links(spark, monkeypatch):
    """Members of one bucket of which no pair is linked, and a group that holds together by its hub alone."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "KEY_ROWS", 4)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 5)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, other = [word() for _ in range(200)], [word() for _ in range(200)]

    def changed(text, times, size):
        out = list(text)
        for _ in range(times):
            at = rng.randrange(len(out) - size)
            out[at : at + size] = [word() for _ in range(size)]
        return " ".join(out)

    texts = [" ".join(base)] + [changed(base, 1, 14) for _ in range(25)] + [changed(other, 3, 12) for _ in range(25)] + [changed(base, 4, 2) for _ in range(10)]
    texts = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == brute(texts) and 1 < len(set(got.values())) < len(texts)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-40, 40, rng.integers(0, 60))) for _ in range(9)]
    got = neardup.overlaps(sets[:4], sets[4:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]).all()
    assert neardup.overlaps(sets[:1], []).shape == (1, 0)
    data = neardup.bag_bytes((np.array([5, 9], np.uint64), np.array([3, 1])))
    assert len(set(neardup.tokens_of(data).tolist())) == 4


def test_null_ids_and_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}x{i // 7}" for i in range(120_000))
    rows = [(1, long), (2, long + " end"), (None, long), (None, "alone with no id at all here"), (3, "word " * 100_000), (4, "word " * 99_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (None, None), (3, 3), (4, 3)], key=str)


def test_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_neardup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(texts)
