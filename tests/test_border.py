import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from veilframe.operators import conversations, evaluation, gateway, plain, policy
from veilframe.plans.intermediate import streamed
from veilframe.streaming import restore


def one(spark, value, *columns):
    return list(spark.createDataFrame([(value,)], "v string").select(*(c(F.col("v")).alias(str(i)) for i, c in enumerate(columns))).first())


def test_plain_detector(spark):
    texts = [None, "", "😀 card 4111 1111 1111 1112, call +7 495 1234567.", "see https://a.example/x?k=1). ann@b.example"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = plain.detect(df).orderBy("i").select("text", plain.entities(F.col("detections")).alias("e")).collect()
    assert [r["e"] or [] for r in rows[:2]] == [[], []]
    for r in rows:
        assert all(r["text"][e["start"] : e["end"]] == e["text"] and e["confidence"] == 1.0 and e["method"] == "regex" for e in r["e"] or [])
    assert [e["type"] for e in rows[2]["e"]] == ["CARD_NUMBER", "PHONE"]  # no checksum here
    assert [e["text"] for e in rows[3]["e"]] == ["https://a.example/x?k=1", "ann@b.example"]


def test_actions(spark):
    rules = plain.actions([{"entity_type": "phone", "action": "redact"}, {"action": "block"}, {"entity_type": "URL", "action": "shred"}], public={"domains": ["B.example"], "people": ["Иван  Петров"]})
    assert rules.by_type == {"PHONE": "REDACT", "API_KEY": "BLOCK", "CARD_NUMBER": "BLOCK"}
    assert plain.actions([], block_keys=False, block_cards=False).by_type == {"API_KEY": "MASK"}
    texts = ["to ann@b.example", "to ann@c.example", "card 4111 1111 1111 1111 and ann@c.example", None, "Иван Петров here"]
    got = plain.strike(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), rules).orderBy("i").collect()
    assert [r["struck"] for r in got] == ["to ann@b.example", "to " + "█" * 13, None, None, "Иван Петров here"]
    assert [list(r["blocked"] or []) for r in got] == [[], [], ["CARD_NUMBER"], [], []]
    seen = plain.detect(spark.createDataFrame([(texts[2],)], "text string")).select(plain.verdict(F.col("detections"), rules).alias("v"), plain.sensitive(F.col("detections"), rules).alias("s")).first()
    assert (seen["v"]["action"], seen["v"]["blocked"], seen["s"]) == ("BLOCK", ["CARD_NUMBER"], True)


def test_actions_as_a_policy():
    made = plain.to_policy({"PHONE": "redact", "API_KEY": "block", "FILE_PATH": "mask"})
    assert [(r.id, r.priority, r.action) for r in made.rules] == [("legacy-api-key", 100_000, "BLOCK"), ("legacy-file-path", 99_999, "TOKENIZE"), ("legacy-phone", 99_998, "REDACT")]
    assert made.default == "BLOCK"
    with pytest.raises(ValueError):
        plain.to_policy({"PHONE": "drop"})


def test_small_checks(spark):
    sha = hashlib.sha256(b"abc").hexdigest()
    who = lambda v: gateway.limit_identity(v, F.lit("h"))
    assert one(spark, "Bearer abc", who)[0] == one(spark, "abc", who)[0] == f"token:{sha}"
    assert one(spark, "", who)[0] == one(spark, None, who)[0] == "client:h"
    stems = {"a/b\\c d.tar.gz": "cdtar", None: "file", "": "file", ".bashrc": "bashrc", "я.txt": "file", "x" * 70: "x" * 60, "dir/": "dir"}
    for name, stem in stems.items():
        assert one(spark, name, gateway.safe_stem)[0] == stem, name
    for value, good in (("a" * 8, True), ("a" * 129, False), ("short", False), ("abcdefg\n", False)):
        got = one(spark, value, gateway.conversation_id)[0]
        assert (got["id"], got["error"]) == ((value, None) if good else (None, "conversation id"))
    assert tuple(one(spark, "", gateway.conversation_id)[0]) == tuple(one(spark, None, gateway.conversation_id)[0]) == (None, None)
    assert one(spark, "éé", lambda v: gateway.too_large(v, 3), lambda v: gateway.too_large(v, 4), lambda v: gateway.too_large(v, 4, F.lit(5))) == [True, False, True]
    assert one(spark, '{"z":1,"a":2,"b":3}', lambda v: gateway.unknown_keys(v, ("a",)))[0] == ["b", "z"]
    assert one(spark, "models/m", gateway.model_name)[0] == "m"
    assert one(spark, "x", lambda v: gateway.instruction(F.array().cast("array<string>")))[0] is None


def test_answers_and_media(spark):
    def wrong(message):
        return one(spark, json.dumps({"choices": [{"message": message}]}), gateway.response_error)[0]

    assert wrong({"role": "assistant", "refusal": "no"}) is None
    assert wrong({"role": "assistant", "content": [], "tool_calls": None}) is None
    assert wrong({"role": "assistant", "refusal": 1}).endswith(".refusal: no text")
    assert wrong({"role": "assistant", "content": "a", "tool_calls": {}}) == "$.choices[0].message.tool_calls: no list"
    assert wrong({"role": "assistant", "tool_calls": [{"type": "function", "id": "a", "function": {"name": 1}}]}).startswith("$.choices[0].message.tool_calls[0].function:")
    assert wrong("text") == "$.choices[0].message: no object"
    for body in (None, "", "[]", "{}"):
        assert one(spark, body, gateway.response_error)[0] is not None
        assert one(spark, body, gateway.unsafe_media)[0] is None
    assert one(spark, '{"messages":[{"content":[1,{"type":"text"}]},5,{"content":{"type":"IMAGE"}}]}', gateway.unsafe_media)[0] == "image"
    assert one(spark, '{"messages":[{"content":"[{\\"type\\":\\"image\\"}]"}]}', gateway.unsafe_media)[0] is None


def test_instruction_goes_after_the_leading_system_messages(spark):
    rows = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "system", "c"), (2, 0, "system", "d"), (3, 0, None, "e")]
    said = spark.createDataFrame([(1, "S"), (2, "S"), (3, None)], "conv_id int, instruction string")
    out = conversations.instruct(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), said).orderBy("conv_id", "turn", "part").collect()
    assert "".join(r["text"] for r in out) == "aSbcdSe"


RULE = "position int, id string, priority double, action string, reason string, obligations array<string>, conditions map<string,array<string>>, ranges map<string,double>"


def test_rules_of_a_file(spark):
    good = (0, "a", 1.0, "BLOCK", "why", None, {"entity_types": ["email"], "risk_buckets": ["LOW"]}, {"min_risk_score": 5.0})
    change = lambda i, k, v: (i, *(v if j == k else f"b{i}" if j == 1 else i + 1.0 if j == 2 else x for j, x in enumerate(good) if j))
    rows = [
        good, change(1, 1, "a "), change(2, 2, 1.0), change(3, 2, 1.5), change(4, 6, {"shoes": ["x"]}), change(5, 6, {"risk_buckets": ["low"]}), change(6, 7, {"max_confidence": 1.5}), change(7, 5, []), change(8, 4, None),
        change(9, 7, {"min_risk_score": 9.0, "max_risk_score": 3.0}), change(10, 3, None), change(11, 6, None), change(12, 6, {"roles": ["u", ""]}), change(13, 2, None),
    ]
    errors = {r["position"]: r["error"] for r in policy.rule_errors(spark.createDataFrame(rows, RULE)).collect()}
    parts = {1: "[1].id: taken", 2: ".priority: taken", 3: "not whole", 4: "unknown member", 5: "unknown value", 6: "not in 0..1", 7: "no members", 8: ".reason", 9: "over the most", 10: ".action", 12: "an empty member", 13: "missing"}
    assert errors.keys() == parts.keys() and all(text in errors[k] for k, text in parts.items()), errors
    assert policy.rule_errors(spark.createDataFrame([], RULE)).count() == 0


def test_assertions_of_a_file(spark):
    schema = "position int, id string, entity_type string, value_sha256 string, action string, reason string, provenance string, obligations array<string>, scope map<string,array<string>>, expires_at string"
    scope = {"tenants": ["t"], "applications": ["a"], "directions": ["INPUT"], "providers": ["p"], "purposes": ["x"]}
    good = (0, "a", "email", "0" * 64, "ALLOW", "why", "me", None, scope, "2999-01-01T00:00:00Z")
    change = lambda i, k, v: (i, *(v if j == k else f"b{i}" if j == 1 else str(i) * 64 if j == 3 else x for j, x in enumerate(good) if j))
    rows = [good, change(1, 2, "PHONE"), change(2, 3, "xyz"), change(3, 4, "BLOCK"), change(4, 8, {**scope, "tenants": []}), change(5, 8, {"tenants": ["t"]}), change(6, 9, "2999-01-01T00:00:00"), change(7, 9, "soon"), change(8, 1, "a"), change(9, 3, "0" * 64)]
    errors = {r["position"]: r["error"] for r in policy.assertion_errors(spark.createDataFrame(rows, schema)).collect()}
    parts = {1: "never public", 2: "SHA-256", 3: "ALLOW", 4: ".scope.tenants", 5: ".scope.applications", 6: "no time zone", 7: ": no time", 8: ".id: taken", 9: "value taken in it"}
    assert errors.keys() == parts.keys() and all(text in errors[k] for k, text in parts.items()), errors


def test_corpus_of_cases(spark, tmp_path):
    case = {"id": "c1", "locale": "en", "text": "aa a@b.example aaa a@b.example", "entities": [{"type": "EMAIL", "value": "a@b.example"}, {"type": "EMAIL", "value": "a@b.example", "occurrence": 1}, {"type": "X", "value": "aa", "occurrence": 1}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(case) + "\n\n")
    cases = evaluation.load(spark, str(tmp_path))
    assert [(r["entity_type"], r["start"], r["end"]) for r in evaluation.expected(cases).orderBy("entity_type", "start").collect()] == [("EMAIL", 3, 14), ("EMAIL", 19, 30), ("X", 15, 17)]
    got = evaluation.evaluate(cases)
    assert [tuple(r)[:4] for r in got.collect()] == [("EMAIL", 2, 0, 0), ("X", 0, 0, 1)]
    said = json.loads(evaluation.report(got, "BALANCED", cases, "1").first()["report"])
    assert list(said) == sorted(said) and said["case_count"] == 1 and said["per_entity"]["X"]["precision"] == 1.0
    (tmp_path / "b.jsonl").write_text(json.dumps(case))
    with pytest.raises(ValueError, match="c1"):
        evaluation.load(spark, str(tmp_path))
    missing = {**case, "entities": [{"type": "X", "value": "zz"}]}
    os.makedirs(tmp_path / "c")
    (tmp_path / "c" / "a.jsonl").write_text(json.dumps(missing))
    with pytest.raises(Exception, match="not found"):
        evaluation.expected(evaluation.load(spark, str(tmp_path / "c"))).collect()


PAIRS = [("<T1>", "one"), ("<T12>", "twelve")]


def test_restored_alike_however_a_text_is_cut():
    text = "a <T1> < b <T12><T1"
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            held, out = "", ""
            for part in (text[:i], text[i:j], text[j:]):
                shown, held = restore.push(held, part, PAIRS)
                out += shown
            assert out + restore.restored(held, PAIRS) == "a one < b twelve<T1", (i, j)


def test_stream_restores(spark, tmp_path):
    schema = "stream_id string, seq long, fragment string, done boolean, pairs array<struct<replacement:string,original:string>>"
    rows = [("s", 0, "a <T", False, PAIRS), ("s", 1, "1> b", False, PAIRS), ("s", 2, None, True, PAIRS), ("t", 0, "<T1", True, None), ("u", 0, "x <T1", False, PAIRS)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streamed(restore.restore(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), None)).orderBy("stream_id", "seq").collect()
    assert [(r["stream_id"], r["text"]) for r in out] == [("s", "a "), ("s", "one b"), ("s", ""), ("t", "<T1"), ("u", "x ")]
