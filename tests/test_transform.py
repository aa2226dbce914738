import hashlib

import pytest
from pyspark.sql import functions as F

from veilframe.functions.spans import spans
from veilframe.operators import detect, mask, metrics, policy, transform, wire
from veilframe.plans import patterns

TEXT = "text string, scope_id string, tenant string, ord int"
RULES = policy.Policy(
    (
        policy.Rule("address", 30, "TOKENIZE", {"entity_type": ("EMAIL",)}),
        policy.Rule("link", 20, "ALLOW", {"entity_type": ("URL",)}),
        policy.Rule("money", 10, "HASH", {"entity_type": ("MONEY",)}),
    )
)


def test_transform_fails_closed(spark):
    rows = [
        ("to a@example.com and a@example.com", "s", "t", 1), ("pay 20 EUR to a@example.com", "s", "t", 2), ("see https://example.com/x", "s", "t", 3),
        ("<MG_r_EMAIL_1> b@example.com", "s", "t", 4), (None, "s", "t", 5), ("", None, "t", 6), ("b@example.com", None, "t", 7), ("4111 1111 1111 1111", "s", "t", 8),
    ]
    out, table = transform.transform(spark.createDataFrame(rows, TEXT), RULES, order="ord", opaque=False)
    got = {r["ord"]: r for r in out.collect()}
    assert got[1]["masked"] == "to <MG_r_EMAIL_1> and <MG_r_EMAIL_1>"
    assert (got[2]["masked"], got[2]["error"], got[2]["blocked"]) == (None, "blocked", ["MONEY"])
    assert got[3]["masked"] == rows[2][0] and got[3]["error"] is None
    assert (got[4]["masked"], got[4]["error"]) == (None, "reserved_token")
    assert got[5]["masked"] is None and got[5]["error"] is None and got[6]["masked"] == ""
    assert got[7]["masked"] == "<MG_r_EMAIL_1>"  # a null scope is a scope of its own
    assert got[8]["blocked"] == ["CARD_NUMBER"]  # no rule: the default denies
    back = {r["ord"]: r["restored"] for r in mask.restore(out, table).collect()}
    assert back[1] == rows[0][0] and back[7] == "b@example.com" and back[2] is None
    assert len(got) == len(rows)


@pytest.mark.parametrize("mode", ["placeholder", "semantic_placeholder", "surrogate", "redact"])
def test_one_scope_over_many_rows(spark, mode):
    texts = [f"mail u{i % 7}@example.com now" for i in range(40)] + ["nothing here", None]
    df = spark.createDataFrame([("s" if i % 2 else None, t) for i, t in enumerate(texts)], "scope_id string, text string")
    rows, table = mask.mask(detect.detect(df), mode, key="k")
    got = mask.restore(rows, table).select("text", "masked", "restored").collect()
    assert len(got) == len(texts)
    for r in got:
        found = r["text"] is not None and "@" in r["text"]
        assert ("u" in (r["masked"] or "") and "@example.com" in r["masked"]) is False
        assert r["restored"] == (r["text"] if mode != "redact" or not found else "mail [REDACTED_EMAIL] now")


def test_principals(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("Bearer abc", "h"), ("bearer  x", "h"), ("Basic abc", "h"), ("Bearer ", "h"), ("", "h"), (None, ""), (None, None), ("Bearer " + "x" * 2_000_000, "h")]
    df = spark.createDataFrame(rows, "a string, c string")
    got = [tuple(r["p"]) for r in df.select(metrics.principal(F.col("a"), F.col("c")).alias("p")).collect()]
    named = lambda s: (f"credential:{sha(s)[:32]}", f"credential:{sha(s)[32:]}", "bearer")
    local = lambda s: ("local", f"client:{sha(s)[:32]}", "local")
    assert got == [named("abc"), named(" x"), named("Basic abc"), named("Bearer "), local("h"), local("unknown"), local("unknown"), named("x" * 2_000_000)]


def test_bare_passport_not_inside_a_labelled_one(spark):
    df = spark.createDataFrame([("паспорт 1234 567890",), ("1234 567890",)], "text string")
    got = [[(d["entity_type"], round(d["confidence"], 2)) for d in r["detections"]] for r in detect.detect(df, profile="STRICT").collect()]
    assert ("PASSPORT", 0.94) in got[0] and ("PASSPORT", 0.58) in got[1]


def test_bodies_with_null_and_repeated_ids(spark):
    rows = [(None, '{"a": 7}'), ("x", '{"a": "b"}'), ("x", '{"a": 7}'), ("y", None)]
    none = F.lit(None).cast("array<string>")
    df = spark.createDataFrame(rows, "request_id string, body string").select("*", F.lit("custom").alias("provider"), none.alias("tokens"), none.alias("values"))
    got = sorted(((r["request_id"], r["violation"]) for r in wire.violations(df).collect()), key=str)
    wrong = "unclassified numeric value at $.a"
    assert got == sorted([(None, wrong), ("x", None), ("x", wrong), ("y", "provider payload is not a JSON object")], key=str)


SAMPLES = """tax id: 1234567894 ИНН 500100732259|СНИЛС 112-233-445 95|DE89 3704 0044 0532 0130 00 DE89370400440532013000|Паспорт № 1234, номер 567890|4510 123456
fe80::1 ::1 1:2:3:4:5:6:7:8|sk-abcdefghijklmnop ghp_abcdefghijklmnopqrst xoxb-1234567890|API key = "abcdefghijkl/+=" Password:\n'abcdefghijklmnop'
https://user:pw@host/x HTTP://EXAMPLE.com|a.b@c-d.example|C:\\dir\\sub\\file.txt \\\\host\\share\\f.doc|/usr/local/bin /a/b|4111-1111-1111-1111|10.0.0.1 255.255.255.255.
+7 (495) 123-45-67|12\xa0345,50 руб. 5 ДОЛЛАРОВ 7евро 1,234.50 usd|$ 12,000.50 €5 £7 ₽9|sub.Example.co.uk:8080|Иван Петров Сидорович Анна-Мария Ли|eyJa.eyJb.c|-----BEGIN RSA PRIVATE KEY-----"""


def test_gates_lose_nothing(spark):
    """With and without gates and cues, every pattern finds the same."""
    parts = [p for line in SAMPLES.split("\n") for p in line.split("|")]
    df = spark.createDataFrame([(" ".join(parts),), *((p,) for p in parts), ("",), (None,)], "text string")
    for s in (*patterns.SECRETS, *patterns.STRUCTURED, patterns.BARE_PASSPORT, *patterns.NETWORK, *patterns.LEGACY):
        text = F.col("text")
        got = df.select(spans(text, s.pattern, s.group, s.cue, s.gate).alias("a"), spans(text, s.pattern, s.group).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), s
        assert sum(len(r["a"]) for r in got) > 0, s


def test_rewrite_keeps_the_shape(spark):
    bodies = ['{"a": ["x", {"b.c": "x", "n": 1.5}], "x": null, "j": "[\\"x\\"]"}', "[1]", None, "{}", '{"é": "x"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "request_id long, body string")
    out = wire.rewrite(df, lambda leaves: leaves.withColumn("new", F.when(F.col("text") == "x", F.concat("keys", F.lit("!")))))
    got = {r["request_id"]: r["rewritten"] for r in out.collect()}
    assert got == {0: '{"a":["a!",{"b.c":"a.b\\\\.c!","n":1.5}],"x":null,"j":"[\\"x\\"]"}', 1: None, 2: None, 3: "{}", 4: '{"é":"é!"}'}


@pytest.mark.parametrize("shapes", [200, 0])
def test_surrogates_of_a_large_scope_are_met_by_their_ends(spark, monkeypatch, shapes):
    """Each text gets the pairs that stand in it, of which one begins like another, and is restored by the longest."""
    monkeypatch.setattr(mask, "SEARCHED", 3)
    monkeypatch.setattr(mask, "SHAPES", shapes)
    table = [(s, "PHONE", f"p{n}", f"+1 202-555-{n % 10_000:04d} ext {n}", True) for s in (1, None) for n in (1, 2, 10, 10_001)] + [(2, "X", "few", "$1", True), (1, "X", "y", "é", True), (1, "X", "gone", "g", False)]
    made = spark.createDataFrame(table, "scope_id int, entity_type string, original string, replacement string, restore boolean")
    texts = [(1, "a +1 202-555-0001 ext 10001, é"), (None, "+1 202-555-0010 ext 10"), (2, "$1 +1 202-555-0001 ext 1"), (1, None), (1, "none"), (3, "+1 202-555-0001 ext 1")]
    df = spark.createDataFrame(texts, "scope_id int, masked string")
    got = {(r["scope_id"], r["masked"]): r for r in mask.restore(df, made).collect()}
    assert [got[k]["restored"] for k in texts] == ["a p10001, y", "p10", "few +1 202-555-0001 ext 1", None, "none", "+1 202-555-0001 ext 1"]
    pairs = {(r["scope_id"], r["masked"]): {p["original"] for p in r["pairs"]} for r in mask.scope_pairs(df, made).collect()}
    assert [pairs[k] for k in texts] == [{"p1", "p10001", "y"}, {"p10"}, {"few"}, set(), set(), set()]
