import hashlib
import random

from veilframe.llm import queries, substrings


def brute(texts):
    """Removed runs and kept bytes, by looking every 50-byte string up in all smaller documents."""
    first, out = {}, {}
    for d, text in texts:
        for i in range(len(text) - 49):
            first.setdefault(text[i : i + 50], d)
    for d, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - 49):
            if first[text[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[d] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def compare(rows, texts):
    want = brute(sorted((d, (t or "").encode()) for d, t in texts))
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def made_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abeéß") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(k)) for k in (8, 12, 15, 20, 40, 90)] + ["ab" * 60, "x" * 200]
    texts = [None, "", "short"]
    while len(texts) < n:
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 3))]
        for p in rng.sample(passages, rng.randint(0, 4)):
            a = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, len(parts)), p[a : len(p) - rng.randint(0, len(p) // 3)])
        texts.append(" ".join(parts))
    texts += rng.sample(texts[3:], 6)
    ids = rng.sample(range(-5, 500), len(texts))
    return list(zip(ids, texts, strict=True))


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        texts = made_texts(seed)
        docs = spark.createDataFrame([(d, t, b"x") for d, t in texts], "doc_id long, text string, raw binary").repartition(3)
        compare(substrings.remove_repeats(docs).collect(), texts)


def test_hot_passage_and_levels(spark):
    passage = "this passage is in each of the documents, and it is longer than fifty bytes by far. " * 2
    texts = [(i, f"own {i * 7919} {passage}{'end' * (i % 3)}") for i in range(300)] + [(1000, passage * 50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    compare(substrings.remove_repeats(docs).collect(), texts)


def test_no_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a" * 80), (None, "a" * 80), (3, "a" * 80), (3, "a" * 80)], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in substrings.remove_repeats(docs).collect())
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    compare(queries.op8_substrings(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in docs])


def test_outlying_ids(spark):
    passage = "a passage that many documents share, of more than fifty bytes, in ranges of ids that differ in width. "
    texts = [(i, f"{i * 7919} {passage[i % 20 :]}") for i in range(200)] + [(2**62, passage), (-(2**62), passage[5:80]), (2**62 + 1, passage + "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    compare(substrings.remove_repeats(docs).collect(), texts)


def test_a_passage_twice_in_one_document(spark):
    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = []
    for i in range(0, 80, 2):
        core = made(60)
        wide = core + made(30)  # of which a smaller document has the core alone
        texts += [(i, made(40) + core + made(40)), (i + 1, made(30) + wide + made(50) + wide + made(20))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    compare(substrings.remove_repeats(docs).collect(), texts)


def test_ids_of_several_texts(spark):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, other = made(90), made(70)
    texts = [(1, shared), (2, shared), (2, made(200)), (2, None), (3, made(90) + shared[:60]), (3, made(60)), (3, other + made(9)), (3, other), (4, other[5:] + made(40)), (4, "short"), (5, shared), (5, shared)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)

    def want(d, t):
        strings = {s[i : i + 50] for e, s in texts if s and e < d for i in range(len(s) - 49)}
        gone = {k for i in range(len(t) - 49) if t[i : i + 50] in strings for k in range(i, i + 50)}
        runs = sum(k - 1 not in gone for k in gone)
        return d, len(t), len(gone), runs, hashlib.sha256("".join(c for k, c in enumerate(t) if k not in gone).encode()).hexdigest()

    rows = [tuple(r)[:5] for r in substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(rows) == sorted(want(d, t or "") for d, t in texts)
