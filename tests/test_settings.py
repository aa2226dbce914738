import json

from pyspark.sql import functions as F

from veilframe.operators import conversations, plain, settings, turns


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "request_id long, body string")


def test_settings(spark):
    one = {"model": "m", "contents": [], "generationConfig": {"maxOutputTokens": 5, "temperature": 1, "topP": 0.5, "stopSequences": ["a", "b"]}, "stream": True}
    inner = lambda **k: one | {"generationConfig": k}
    given = [one, inner(stopSequences="a", temperature=None), {"model": "m"}, inner(topK=1), inner(maxOutputTokens=1.5), inner(maxOutputTokens=True), inner(stopSequences=[1]), one | {"generationConfig": []}, one | {"stream": "x"}, {"contents": []}, one | {"seed": {"a": 1}}, one | {"other": 1}, "[]", None, inner(responseSchema={})]
    got = settings.settings(frame(spark, *given), "generate", extensions=("seed",)).orderBy("request_id").drop("request_id").collect()
    assert [tuple(r) for r in got[:3]] == [("m", 5, 1.0, 0.5, ["a", "b"], True, False, None, None), ("m", None, None, None, ["a"], True, False, None, None), ("m", None, None, None, [], False, False, None, None)]
    c = "$.generationConfig"
    assert [r["error"] for r in got] == [None, None, None, f"{c}.topK", f"{c}.maxOutputTokens", f"{c}.maxOutputTokens", f"{c}.stopSequences", c, "$.stream", "$.model", None, "$.other", "$", "$", None]
    assert got[10]["extensions"] == '{"seed":{"a":1}}' and all(v is None for r in got if r["error"] for v in tuple(r)[:-1])
    allowed = turns.content(frame(spark, one | {"seed": 1, "contents": [{"role": "user", "parts": [{"text": "t"}]}]}), "generate", extensions=("seed",)).collect()
    assert [(r["text"], r["error"]) for r in allowed] == [("t", None)]


def test_storage(spark):
    given = frame(spark, {"model": "m", "input": "x", "store": True}, {"model": "m", "input": "x", "store": 1}, {"model": "m", "input": "x", "store": None})
    for allowed in (False, True):
        got = settings.settings(given, "interactions", storage=allowed).orderBy("request_id").collect()
        assert [(r["store"], r["error"]) for r in got] == [(True, None) if allowed else (None, "$.store"), (None, "$.store"), (False, None)]
    stored = settings.settings(frame(spark, {"model": "m", "messages": [], "store": False}), "messages").collect()
    assert stored[0]["error"] == "$.store"


def test_tools(spark):
    def read(protocol, *tools, remote=False):
        rows = settings.tools(frame(spark, {"tools": list(tools)}), protocol, remote=remote).orderBy("tool").collect()
        return [tuple(r)[2:] for r in rows]

    f = {"name": "f", "description": "d", "parameters": {"a": 1}}
    fault = lambda path: (None, None, None, None, None, path)
    assert read("responses", f | {"type": "function"}, f | {"type": "function", "strict": False}, f, f | {"type": "function", "strict": 1}) == [("f", "d", '{"a":1}', True, None, None), ("f", "d", '{"a":1}', False, None, None), fault("$.tools[2]"), fault("$.tools[3].strict")]
    assert read("interactions", f | {"type": "function"}, f | {"type": "function", "strict": False}, {"type": "search"}, remote=True) == [("f", "d", '{"a":1}', False, None, None), fault("$.tools[1]"), (None, None, None, None, '{"type":"search"}', None)]
    assert read("generate", {"functionDeclarations": [f, {"name": "f"}, 1]}, {"codeExecution": {}}, {"functionDeclarations": {}}, 5) == [
        ("f", "d", '{"a":1}', False, None, None), fault("$.tools[0].functionDeclarations[1]"), fault("$.tools[0].functionDeclarations[2]"), fault("$.tools[1]"), fault("$.tools[2].functionDeclarations"), fault("$.tools[3]"),
    ]
    assert read("messages", {"name": 1, "input_schema": {}}, {"name": "f", "description": 2, "input_schema": {}}, {"name": "f", "input_schema": {}}) == [fault("$.tools[0].name"), fault("$.tools[1].description"), ("f", "", "{}", False, None, None)]
    rest = settings.tools(frame(spark, {"tools": {}}, {}, None, {"tools": []}), "messages").select("request_id", "error").where(F.lit(True)).collect()
    assert [tuple(r) for r in rest] == [(0, "$.tools")]


def test_appended_and_trace(spark):
    rows = "conv_id long, turn long, role string, text string"
    old = spark.createDataFrame([(1, 5, "user", "a"), (1, None, "system", "s"), (2, 0, "user", "b")], rows)
    new = spark.createDataFrame([(1, 0, "user", "c"), (3, 0, "user", None), (1, 1, "assistant", "d")], rows)
    got = conversations.appended(old, new).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["position"], r["text"]) for r in got] == [(1, 0, "s"), (1, 1, "a"), (1, 2, "c"), (1, 3, "d"), (2, 0, "b"), (3, 0, None)]
    assert conversations.appended(old.limit(0), new.limit(0)).count() == 0
    found = plain.detect(spark.createDataFrame([(1, "who@mail.example and 10.0.0.1 or you@mail.example"), (2, "none"), (3, None)], "k int, text string"))
    told = {r["k"]: (r["t"]["types"], r["t"]["count"]) for r in found.select("k", plain.trace(F.col("detections")).alias("t")).collect()}
    assert told == {1: (["EMAIL", "IP_ADDRESS"], 3), 2: ([], 0), 3: ([], 0)}
