import json

from pyspark.sql import functions as F

from veilframe.operators import adapters, gateway, mask


def _events(spark, *chunks, **kw):
    rows = [("s", i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(chunks)]
    return [tuple(r)[1:] for r in adapters.stream_events(spark.createDataFrame(rows, "stream_id string, seq int, chunk string"), **kw).orderBy("seq", "event").collect()]


def _delta(finish=None, **delta):
    return {"choices": [{"delta": delta, "finish_reason": finish}]}


def test_stream_events(spark):
    tools = [{"index": 3, "id": "c", "function": {"arguments": "{"}}, {"function": {"name": "f"}}, {"function": {"arguments": "}"}}]
    two = {"choices": [{"index": 5, "delta": {"role": "assistant", "content": "a", "refusal": "b"}}, {"delta": {"function_call": {"arguments": ""}}, "finish_reason": "stop"}]}
    got = _events(spark, two, _delta(tool_calls=tools), {"error": {"code": 7}}, {"choices": []}, {"choices": [{}]})
    assert got == [
        (0, 0, "text", 5, "content", None, "a", None),
        (0, 1, "text", 5, "refusal", None, "b", None),
        (0, 2, "arguments", 1, "function_call.arguments", "choice-1-legacy-function", "", None),
        (0, 3, "finish", 1, None, None, "stop", None),
        (1, 0, "arguments", 0, "tool_calls[3].function.arguments", "c", "{", None),
        (1, 1, "arguments", 0, "tool_calls[2].function.arguments", "choice-0-tool-2", "}", None),
        (2, 0, "failure", None, None, "7", "provider error", None),
    ]
    assert _events(spark, _delta(content="{}"), structured=True)[0][2] == "structured"


def test_chunks_that_are_refused(spark):
    wrong = {
        "$": ["[]", "{", None],
        "$.error": [{"error": "x"}],
        "$.choices": [{}, {"choices": None}, {"choices": {}}],
        "$.choices[0]": [{"choices": [5]}],
        "$.choices[0].index": [{"choices": [{"index": "1"}]}],
        "$.choices[0].delta": [{"choices": [{"delta": None}]}],
        "$.choices[0].delta.audio": [_delta(content="a", video=1, audio=2)],
        "$.choices[0].delta.role": [_delta(role="user"), _delta(role=None)],
        "$.choices[0].delta.content": [_delta(content=["a"])],
        "$.choices[0].delta.function_call": [_delta(function_call="f"), _delta(function_call={"id": 1})],
        "$.choices[0].delta.function_call.arguments": [_delta(function_call={"arguments": {}})],
        "$.choices[0].delta.tool_calls": [_delta(tool_calls=None)],
        "$.choices[0].delta.tool_calls[1]": [_delta(tool_calls=[{}, {"x": 1}])],
        "$.choices[0].delta.tool_calls[0].function": [_delta(tool_calls=[{"function": None}]), _delta(tool_calls=[{"function": {"x": 1}}])],
        "$.choices[0].delta.tool_calls[0].function.arguments": [_delta(tool_calls=[{"function": {"arguments": 1}}])],
    }
    flat = [(path, c) for path, cs in wrong.items() for c in cs]
    got = _events(spark, *[c for _, c in flat])
    assert [(g[2], g[-1]) for g in got] == [("refused", path) for path, _ in flat]


def test_bodies_of_their_rows(spark):
    bodies = [
        {"messages": [{"role": "system", "content": 'be "brief"\n[x]'}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": ""}]}]},
        {"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": '{"a":"\\\\"}'}}]}, {"role": "tool", "tool_call_id": "c", "content": "é$1"}]},
        {"messages": [{"role": "assistant", "content": None, "refusal": "no"}, {"role": "user", "content": ""}]},
        {"messages": [{"role": "robot", "content": "a"}]},
        {"messages": [{"role": "user", "content": "b", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}]},
        {"messages": []},
    ]
    given = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "request_id int, body string")
    got = {r["request_id"]: r for r in adapters.bodies_of(adapters.content(given)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [json.loads(got[i]["body"]) for i in range(3)] == bodies[:3]
    assert [(got[i]["body"], got[i]["error"]) for i in (3, 4)] == [(None, "$.messages[0].role"), (None, "$.messages[0].tool_calls")]


def test_pruned_as_by_brute_force(spark):
    token = "<MG:" + "A" * 26 + ">"
    table = [(s, r, k) for s in (1, 2, None) for r, k in ((token, True), ("<MG_r_EMAIL_1>", True), ("Demo Person 1", True), ("$1", True), ("x", True), ("é😀", True), ("gone", False), ("", True), ("sk-test-0001", True))]
    texts = [(1, f"a{token}b <MG_r_EMAIL_12>"), (1, "Demo Person 12 for $2"), (2, "é😀 and <MG_r_EMAIL_1>; gone"), (2, None), (2, ""), (None, "x$1"), (3, "sk-test-0001"), (1, "0001")]
    got = mask.pruned(spark.createDataFrame([(s, "T", r, r, k) for s, r, k in table], "scope_id int, entity_type string, original string, replacement string, restore boolean"), spark.createDataFrame(texts, "scope_id int, text string"))
    want = [(s, r) for s, r, k in table if k and r and any(s == z and t and r in t for z, t in texts)]
    assert sorted(((r["scope_id"], r["replacement"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert mask.pruned(got.limit(0), spark.createDataFrame(texts, "scope_id int, text string")).count() == 0


def test_pruned_takes_apart_texts_of_large_scopes_only(spark, monkeypatch):
    table = [(s, f"name {k}") for s in (1, None) for k in range(5)] + [(2, "x"), (2, "name 1")]
    texts = [(1, "name 3 and name 12"), (None, "name 4"), (2, "an axe"), (3, "name 0")]
    made = spark.createDataFrame([(s, "T", r, r, True) for s, r in table], "scope_id int, entity_type string, original string, replacement string, restore boolean")
    want = [(1, "name 1"), (1, "name 3"), (2, "x"), (None, "name 4")]
    for most in (256, 3, 0):
        monkeypatch.setattr(mask, "SEARCHED", most)
        got = mask.pruned(made, spark.createDataFrame(texts, "scope_id int, text string"))
        assert ("(?s)(?=(" in got._jdf.queryExecution().optimizedPlan().toString()) == (most < 256)
        assert sorted(((r["scope_id"], r["replacement"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_admission_and_log_lines(spark):
    asked = spark.createDataFrame([("Bearer k1",), ("bearer k 2",), ("BEARER  k1",), ("Bearer ",), ("k1",), ("Basic k1",), ("",), (None,)], "authorization string")
    keys = spark.createDataFrame([("k1",), ("k1",), ("k 2",), ("",), (None,)], "key string")
    assert {r["authorization"] for r in gateway.admitted(asked, keys).where("admitted").collect()} == {"Bearer k1", "bearer k 2"}
    assert gateway.admitted(asked, keys).count() == 8
    lines = spark.createDataFrame([("request_done", "r", 200, "secret"), ("Got mail of a@b.example", None, None, "secret"), ("a\n", "r", 1, "x"), (None, None, None, None)], "message string, request_id string, status_code int, body string")
    out = [json.loads(r[0]) for r in lines.select(gateway.log_line(lines)).collect()]
    assert out[0] == {"message": "request_done", "request_id": "r", "status_code": 200}
    assert out[1:] == [{"message": "log_suppressed"}, {"message": "log_suppressed", "request_id": "r", "status_code": 1}, {"message": "log_suppressed"}]


def test_approved(spark):
    rows = spark.createDataFrame([(["<MG_r_A_1>", "Demo 1", "Demo 1", None], ["ok"]), (None, None)], "r array<string>, a array<string>")
    got = [r[0] for r in rows.select(gateway.approved(F.col("r"), F.col("a"), mask.SEMANTIC)).collect()]
    assert got[0]["tokens"] == ["<MG_r_A_1>"] and got[0]["values"] == ["Demo 1", "ok"] and got[1]["values"] == []
