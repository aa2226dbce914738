import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from veilframe.llm import queries, rules


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "a b c d e", "a b c d e f a b c d e f g h i j k l m n", "x\ny\nx\n\n\n x\nf f\x0cf",
    "é😀 ß #*$ %&|<>", "a " * 3000, " ".join(str(i) for i in range(40)), "clean words stand here and nothing repeats in this line of plain prose",
    "SHOUT LOUD WORDS ARE HERE AND THEY GO ON FOR MORE THAN TEN", "one two three four five six seven eight nine ten\u2028eleven",
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2)], "doc_id long, text string, words int")
    got = rules.judge(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert {k: r[k] for k in brute("")} == brute(TEXTS[r["doc_id"]]), r
    by = {r["doc_id"]: r for r in got}
    assert by[9]["kept"] and by[11]["kept"]
    assert by[8]["rejected_by"] in ("digits", "word_length") and by[10]["rejected_by"] == "capitals" and by[7]["rejected_by"] == "base"


def test_order_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "some words " * 6) for i in range(50)], "doc_id long, text string")
    given = [rules.Rule("never", F.lit(False)), rules.Rule("always", F.col("n_words") > 1)]
    assert [r.name for r in rules.ordered(docs, given)] == ["always", "never"]
    assert [r.name for r in rules.ordered(docs.limit(0), given)] == ["never", "always"]
    assert rules.judge(docs.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    plan = queries.op5_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_sql(spark):
    got = queries.op5_rules(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(rules.ORACLE)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_greedy_order_is_conditional():
    """The second rule rejects most of what is left, though the third rejects more in all."""
    a, b, c = (rules.Rule(n, F.lit(True)) for n in "abc")
    masks = {0b000: 5, 0b101: 50, 0b001: 10, 0b010: 20, 0b100: 1}
    assert [r.name for r in rules.greedy([a, b, c], masks, [1.0, 1.0, 1.0])] == ["a", "b", "c"]
    assert [r.name for r in rules.greedy([a, b, c], masks, [100.0, 1.0, 1.0])] == ["c", "b", "a"]
    assert [r.name for r in rules.greedy([c, b, a], {0: 9}, [2.0, 1.0, 1.0])] == ["b", "a", "c"]
