import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, mix_epoch string").drop("mix_epoch")


def corpus():
    rows = [(i, "big", "w " * (i % 7 + 1), None) for i in range(300)]
    rows += [(1000 + i, "small", "w " * 3, None) for i in range(40)]
    return rows + [(2000 + i, "tiny", "a b", None) for i in range(30)] + [(3000, None, None, None), (3001, "", "", None), (None, "tiny", "x", None)]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 10**6), max_size=8), st.floats(0.1, 1.0), st.floats(1.0, 5.0))
def test_exponent(totals, target, most):
    a = mixing.exponent_for(totals, target, most)
    w = mixing.weights(totals, a)
    assert 0 <= a <= 1
    assert mixing.repetitions(totals, w) <= most + 1e-6
    n = sum(1 for v in totals.values() if v)
    if n > 1 and mixing.entropy(w) < target * math.log(n) - 1e-6:  # only the repetition limit may hold it back
        assert a > 0 and mixing.repetitions(totals, mixing.weights(totals, max(a - 1e-3, 0))) > most - 0.02


def test_schedule_meets_the_budgets(spark):
    rows = corpus()
    got = mixing.schedule(frame(spark, rows), target=0.95, most=3.0, block_tokens=50).collect()
    totals, shown = Counter(), defaultdict(Counter)
    for d, s, t, _ in rows:
        totals[s or ""] += len((t or "").split())
    for r in got:
        assert r["mix_tokens"] == len((r["text"] or "").split())
        shown[r["mix_source"]][r["doc_id"]] += 1
    w = mixing.weights(totals, mixing.exponent_for(totals, 0.95, 3.0))
    budget = mixing.covering_budget(totals, w)
    tokens = Counter()
    for r in got:
        tokens[r["mix_source"]] += r["mix_tokens"]
    for s, n in totals.items():
        want = max(n, int(budget * w[s] + 1e-6))
        assert want - 8 < tokens[s] <= want  # short by less than one document
        times = set(shown[s].values())
        assert max(times) - min(times) <= 1 and min(times) >= 1
    assert {r["doc_id"] for r in got} == {d for d, *_ in rows}
    keys = [r["mix_key"] for r in got if r["mix_source"] == "big"]
    assert 0 <= min(keys) and max(keys) < mixing.SCALE
    again = mixing.schedule(frame(spark, rows).repartition(3), target=0.95, most=3.0, block_tokens=50).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_empty(spark):
    assert mixing.mixed(frame(spark, corpus()).limit(0)).collect() == []


@pytest.mark.parametrize("rows", [[(1, "a", None, None)], [(1, "a", "x", None), (1, "a", "x", None)]])
def test_small(spark, rows):
    assert len(mixing.mixed(frame(spark, rows)).collect()) == len(rows)


def test_clashing_columns_and_few_ranges(spark):
    names = ["mix_source", "left", "size", "blocks", "total", "budget", "mix_fine", "upto", "hash", "range", "before", "_c0"]
    docs = frame(spark, corpus())
    more = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    got = mixing.mixed(more, target=0.95, most=3.0, block_tokens=50).collect()
    want = mixing.mixed(docs, target=0.95, most=3.0, block_tokens=50).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in want)
    assert all(r[n] == f"own {n}" for r in got for n in names)
    assert mixing.schedule(more).columns == ["doc_id", "source", "text", *names[1:], *mixing.MIX]


@pytest.mark.parametrize("target", [0.5, 1.0])
def test_rows_against_sql(spark, tmp_path, target):
    rows = [(i, None if i % 50 == 7 else "hot", "w " * (i % 9)) for i in range(300)] + [(i, "small", "one two three") for i in range(300, 312)] + [(400, "none", ""), (401, "none", None), (None, "small", "x y")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    got = mixing.schedule(docs, target, 3.0, 40).select("doc_id", "mix_source", "mix_tokens", "mix_epoch", "mix_block", "mix_key").collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = con.sql(mixing.oracle(target, 3.0, 40)).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert max(r["mix_epoch"] for r in got) > 0


def test_words_are_counted_without_making_them(spark):
    texts = [None, "", " ", "a", " a", "a ", " a  b\t\n", "\x0b\x0c\r", "x y z w", "\x1c a\x85b", "漢 字", "𝒳 y\r\nz", "x" * 5000 + " " * 5000 + "y"]
    counted = mixing.token_count(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", counted.alias("n")).collect()
    assert [r["n"] for r in rows] == [len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for t in texts]
    assert "split" not in str(counted)  # an array of words took many times a text's memory
