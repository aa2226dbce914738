import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import packing, queries
from veilframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length string, salt string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("text", ["", " ", "a", "Don't STOP, it's 12.5!\n\nÉtude  ſtraße x ... <|endoftext|> áb", "漢字 kana \x1c\x85 z", "word!! Word!! #tag $5"])
def test_words_give_the_same_ids_as_whole_texts(text):
    ids = packing.WordIds(tokenizer_path(), limit=3)
    for _ in range(2):
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text), "<u4").tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_plan_fills_each_place_once(counts):
    used, ranks = defaultdict(list), defaultdict(set)
    for length, lo, hi, first, per, base in packing.plan_slots(counts, 32):
        for t in range(hi - lo):
            ranks[length].add(lo + t)
            used[first + t // per].append((base + t % per * length, length))
    assert {k: len(v) for k, v in ranks.items()} == counts
    assert all(v == set(range(counts[k])) for k, v in ranks.items())
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 32
    assert len(used) == one_by_one(counts, 32)


def one_by_one(counts, capacity):
    """Sequences that best-fit decreasing opens, item by item."""
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        room = min((r for r in rooms if r >= length), default=None)
        if room is None:
            rooms.append(capacity - length)
        else:
            rooms[rooms.index(room)] -= length
    return len(rooms)


def check(rows, texts, capacity):
    ids = packing.WordIds(tokenizer_path())
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for spans in by_seq.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    assert set(by_doc) == set(range(len(texts)))
    for d, text in enumerate(texts):
        whole = ids(text or "") + b"\0\0\0\0"
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            part = whole[4 * at : 4 * (at + r["length"])]
            assert zlib.crc32(part) == r["ids_crc32"]
            at += r["length"]
        assert 4 * at == len(whole)


def test_pack_small(spark):
    texts = [None, "", "a b c", "a b c", "x " * 5000, "one two three four five six seven", "long " * 30] + ["same text here"] * 40
    for capacity in (16, 2048):
        rows = packing.pack_documents(rows_of(spark, texts), tokenizer_path(), capacity).collect()
        check(rows, texts, capacity)


def test_pack_empty(spark):
    got = packing.pack_documents(rows_of(spark, []), tokenizer_path())
    assert got.collect() == [] and got.columns[-2:] == ["sequence_id", "offset"]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op9_packing(spark, "/root/testdata/sf0.001").collect()
    check(rows, [r["text"] for r in docs], 2048)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= total / 2048 * 1.01 + 1


def test_long_words_in_linear_time(spark):
    """A word of a million letters, beside words around the limit of the bulk merges."""
    import random
    import time

    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (63, 64, 65, 1000, 1_000_000)]
    ids = packing.WordIds(tokenizer_path())
    began = time.perf_counter()
    got = ids(" ".join(words))
    assert time.perf_counter() - began < 30
    assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(" ".join(words), add_special_tokens=False).ids


def test_plan_joined_by_buckets(spark, monkeypatch):
    texts = ["word " * (n % 40) for n in range(400)] + ["same"] * 300
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(packing, "RANK_BUCKET", 16)
    check(packing.pack_documents(rows_of(spark, texts), tokenizer_path(), 32).collect(), texts, 32)


def test_words_merged_together_get_the_tokenizers_ids():
    """Words of one to 64 letters, of one and two bytes, in any case; all others are left to the tokenizer."""
    ids = packing.WordIds(tokenizer_path())
    rng = np.random.default_rng(5)
    letters = list("aAbeEiInorstTuzéÉßµøÿ")
    words = ["".join(rng.choice(letters, n)) for n in [*range(1, 65)] * 8] + ["é" * 64, "a", "THE", "international"]
    taken = ids.merges.takes([*words, "x" * 65, "don't", "it's", "漢字", "Ā", "", "a1", "a b"])
    assert taken == words
    want = [np.asarray(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert ids.merges(words) == want and ids.merges([]) == []
    text = " ".join(f"{w}{t}" for w, t in zip(words, [",", "", "...", "'s", "1"] * len(words), strict=False))
    assert ids(text) == np.asarray(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
