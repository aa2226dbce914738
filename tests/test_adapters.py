import json

from pyspark.sql import functions as F

from veilframe.operators import adapters


def _bodies(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "request_id int, body string")


def test_to_gemini(spark):
    rich = {
        "messages": [
            {"role": "system", "content": "one"},
            {"content": [{"type": "text", "text": "a"}, {"type": "image_url"}, {"type": "text", "text": 5}, "x", {"type": "text", "text": "b"}]},
            {"role": "assistant", "content": None},
            {"role": "assistant", "content": ""},
            {"role": "system", "content": "two"},
        ],
        "temperature": 0.5,
        "top_p": None,
        "stop": ["x", "y"],
    }
    out = [r["payload"] for r in adapters.to_gemini(_bodies(spark, rich, {"messages": []}, {}, {"messages": "no"}, "{", None)).orderBy("request_id").collect()]
    assert json.loads(out[0]) == {
        "contents": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}, {"role": "model", "parts": [{"text": ""}]}],
        "systemInstruction": {"parts": [{"text": "one"}, {"text": "two"}]},
        "generationConfig": {"temperature": 0.5, "stopSequences": ["x", "y"]},
    }
    assert [json.loads(x) for x in out[1:4]] == [{"contents": []}] * 3
    assert out[4:] == [None, None]


def test_from_gemini(spark):
    whole = {"candidates": [{"content": {"parts": [{"text": "a"}, {"b": 1}, {"text": "c"}]}, "finishReason": "SAFETY"}], "usageMetadata": {"totalTokenCount": 3}}
    out = [tuple(r["answer"]) for r in adapters.from_gemini(_bodies(spark, whole, {}, None), F.lit("m"), "body").orderBy("request_id").collect()]
    assert out == [("m", "ac", "safety", 0, 0, 3), ("m", "", "stop", 0, 0, 0), ("m", "", "stop", 0, 0, 0)]


def test_assistant_message(spark):
    said = lambda **m: {"choices": [{"message": m}]}
    bodies = _bodies(spark, said(role="assistant", content=None, tool_calls=[{"id": "a"}], x=1), said(role="user", content="a"), said(role="assistant"), {"choices": []}, "[", None)
    out = [r[0] for r in bodies.orderBy("request_id").select(adapters.assistant_message(F.col("body"))).collect()]
    assert json.loads(out[0]) == {"role": "assistant", "content": None, "tool_calls": [{"id": "a"}]}
    assert out[1:] == [None] * 5


def test_model_names(spark):
    names = spark.createDataFrame([("models/a-1",), ("a b",), ("",), (None,)], "m string")
    out = [r[0] for r in names.select(adapters.target(F.col("m"), F.lit(True))).collect()]
    assert out == ["/models/a-1:streamGenerateContent?alt=sse", None, *[f"/models/{adapters.DEFAULT_MODEL}:streamGenerateContent?alt=sse"] * 2]


def test_content(spark):
    body = {"messages": [{"role": "tool", "tool_call_id": "t", "content": [{"type": "refusal", "refusal": "no"}]}, {"role": "assistant", "content": 5, "refusal": "r"}, {"role": "user"}]}
    rows = adapters.content(_bodies(spark, body, "x", None)).orderBy("message", "item").collect()
    assert [(r["message"], r["item"], r["kind"], r["call_id"], r["text"], r["error"]) for r in rows] == [
        (0, 0, "refusal", "t", "no", None),
        (1, 0, "unsupported", None, None, "$.messages[1].content[0]"),
        (1, 1, "refusal", None, "r", None),
        (2, None, None, None, None, None),
    ]


def test_protocol_errors(spark):
    long_ = "x" * 257
    bodies = _bodies(spark, {"model": "", "service_tier": long_, "messages": [{"role": "tool", "tool_call_id": "a b", "content": long_}]}, {"model": "m/1"}, None, "[")
    out = adapters.protocol_errors(bodies).orderBy("ordinal").collect()
    assert [(r["request_id"], r["path"]) for r in out] == [(0, "$.model"), (0, "$.service_tier"), (0, "$.messages[0].tool_call_id")]


def test_buffered(spark):
    chunk = lambda delta, at=0: json.dumps({"choices": [{"delta": {}}] * at + [{"delta": delta}]})
    rows = [
        ("s", 1, chunk({"content": "b"})),
        ("s", 0, chunk({"content": "a", "refusal": None})),
        ("s", 2, chunk({"function_call": {"arguments": "{}"}}, 1)),
        ("s", 3, chunk({"tool_calls": [{}, {"function": {"arguments": "x"}}]})),
        ("s", 4, "{"),
        ("t", 0, None),
    ]
    out = adapters.buffered(spark.createDataFrame(rows, "stream_id string, seq int, chunk string")).orderBy("choice", "field").collect()
    assert [tuple(r) for r in out] == [("s", 0, "content", "ab"), ("s", 0, "tool_calls[1]", "x"), ("s", 1, "function_call", "{}")]


def test_kept_histories(spark):
    rows = [("a", "c", 0, 0), ("a", "c", 1, 9), ("a", "c", 2, 19), ("b", "c", 3, 5), (None, "c", 4, 5)]
    messages = spark.createDataFrame(rows, "owner string, conv_id string, seq int, at long").withColumn("ts", F.timestamp_seconds("at"))
    out = adapters.kept_histories(messages, 10).orderBy("seq").collect()
    assert [(r["life"], r["behind"]) for r in out] == [(0, 0), (0, 1), (1, 0), (0, 0), (0, 0)]
