import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators import turns


def read(spark, protocol, *bodies):
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "request_id long, body string")
    rows = turns.content(df, protocol).orderBy("request_id", "message", "item").collect()
    return [[(r["role"], r["kind"], r["call_id"], r["name"], r["text"], r["error"]) for r in rows if r["request_id"] == i] for i in range(len(bodies))]


def refused(path, role=None):
    return (role, "refused", None, None, None, path)


def said(role, text):
    return (role, "text", None, None, text, None)


def test_messages(spark):
    one = lambda *m: {"model": "m", "max_tokens": 1, "messages": list(m)}
    user = lambda *b: {"role": "user", "content": list(b)}
    text, use = {"type": "text", "text": "t"}, {"type": "tool_use", "id": "c", "name": "f", "input": {"a": 1}}
    result = {"type": "tool_result", "tool_use_id": "c", "content": "r", "is_error": False}
    got = read(
        spark, "messages", one({"role": "user", "content": "hi"}) | {"system": "s"}, one(user(text), {"role": "assistant", "content": [text, use]}, user(result)), one(user(use)), one(user(result, text)), one(user(result | {"is_error": 1})), one({"role": "tool", "content": "x"}),
        one(user(text | {"x": 1})), one(user({"type": "image"})), one({"role": "user"}), one() | {"metadata": 1}, {"messages": {}}, "[1]", None, "{", one(user()) | {"system": [text, {"type": "x"}]}, one(user(result | {"content": [text]})), one(7),
    )
    assert got == [
        [said("system", "s"), said("user", "hi")],
        [said("user", "t"), said("assistant", "t"), ("assistant", "tool_call", "c", "f", '{"a":1}', None), ("tool", "tool_result", "c", None, "r", None)],
        [refused("$.messages[0].content[0]", "user")], [refused("$.messages[0]")], [refused("$.messages[0].content[0].is_error", "user")], [refused("$.messages[0].role")],
        [refused("$.messages[0].content[0]", "user")], [refused("$.messages[0].content[0]", "user")], [refused("$.messages[0]")], [refused("$.metadata")], [refused("$.messages")], [refused("$")], [refused("$")], [refused("$")],
        [said("system", "t"), refused("$.system[1]", "system"), ("user", None, None, None, None, None)], [("tool", "tool_result", "c", None, '[{"text":"t","type":"text"}]', None)], [refused("$.messages[0]")],
    ]


def test_generate(spark):
    one = lambda *c, **k: {"model": "m", "contents": list(c)} | k
    part = lambda role, *p: {"role": role, "parts": list(p)}
    call, answer = {"functionCall": {"id": "c", "name": "f", "args": {}}}, {"functionResponse": {"id": "c", "name": "f", "response": [1]}}
    got = read(
        spark, "generate", one(part("user", {"text": "t"}), part("model", call), part("user", answer), systemInstruction={"parts": [{"text": "s"}]}), one(part("user", call)), one(part("model", answer)), one(part("assistant", {"text": "t"})), one(part("user", {"text": 1})),
        one(part("user", {"inlineData": {}})), one(part("user", answer, {"text": "t"})), one(systemInstruction={"parts": [{"x": 1}]}), one(systemInstruction="s"), one(part("model", {"functionCall": {"name": "f", "args": {}}})), one({"role": "user", "parts": "t"}),
    )
    assert got == [
        [said("system", "s"), said("user", "t"), ("assistant", "tool_call", "c", "f", "{}", None), ("tool", "tool_result", "c", "f", "[1]", None)],
        [refused("$.contents[0].parts[0]", "user")], [refused("$.contents[0].parts[0]", "assistant")], [refused("$.contents[0].role")], [refused("$.contents[0].parts[0].text", "user")], [refused("$.contents[0].parts[0]", "user")],
        [refused("$.contents[0]")], [refused("$.systemInstruction.parts[0]", "system")], [refused("$.systemInstruction", "system")], [refused("$.contents[0].parts[0].functionCall", "assistant")], [refused("$.contents[0].parts", "user")],
    ]


def test_responses(spark):
    one = lambda *i, **k: {"model": "m", "input": list(i)} | k
    message = lambda role, kind, text="t": {"type": "message", "role": role, "content": [{"type": kind, "text": text}]}
    call, answer = {"type": "function_call", "call_id": "c", "name": "f", "arguments": '{"a":1}'}, {"type": "function_call_output", "call_id": "c", "output": "r"}
    got = read(
        spark, "responses", {"model": "m", "input": "hi", "instructions": "s"}, one(message("developer", "input_text"), message("assistant", "output_text"), call, answer), one(message("user", "output_text")), one(message("tool", "input_text")), one(call | {"arguments": "[1]"}),
        one({"type": "reasoning"}), one(call | {"status": 1}), {"input": 5}, one(instructions=1),
    )
    assert got == [
        [said("system", "s"), said("user", "hi")], [said("developer", "t"), said("assistant", "t"), ("assistant", "tool_call", "c", "f", '{"a":1}', None), ("tool", "tool_result", "c", None, "r", None)],
        [refused("$.input[0].content[0]", "user")], [refused("$.input[0].role")], [refused("$.input[0].arguments")], [refused("$.input[0]")], [refused("$.input[0]")], [refused("$.input")], [refused("$.instructions", "system")],
    ]


def test_interactions(spark):
    one = lambda *i, **k: {"model": "m", "input": list(i)} | k
    text = {"type": "text", "text": "t"}
    call, answer = {"type": "function_call", "id": "c", "name": "f", "arguments": {}}, {"type": "function_result", "call_id": "c", "name": "f", "result": {"x": 1}}
    got = read(
        spark, "interactions", one({"type": "user_input", "content": [text]}, {"type": "model_output", "content": [text]}, call, answer, system_instruction="s"), one({"type": "user_input", "content": "t"}), one({"type": "thought"}), one(call | {"arguments": "{}"}), one({"type": "user_input", "content": [{"type": "image"}]}),
    )
    assert got == [
        [said("system", "s"), said("user", "t"), said("assistant", "t"), ("assistant", "tool_call", "c", "f", "{}", None), ("tool", "tool_result", "c", "f", '{"x":1}', None)],
        [refused("$.input[0].content", "user")], [refused("$.input[0]")], [refused("$.input[0].arguments")], [refused("$.input[0].content[0]", "user")],
    ]


ROWS = "request_id long, message int, item int, role string, kind string, call_id string, name string, text string, error string"


@pytest.mark.parametrize("protocol", turns.PROTOCOLS)
def test_written_and_read(spark, protocol):
    row = lambda k, m, role, kind, text, call=None, name=None, item=0, error=None: (k, m, item, role, kind, call, name, text, error)
    given = [
        row(1, 0, "system", "text", 'be "brief"\n'), row(1, 1, "user", "text", "a\\b"), row(1, 2, "assistant", "text", "x"), row(1, 2, "assistant", "tool_call", '{"q":[1]}', "c", "f", 1), row(1, 3, "tool", "tool_result", '{"r":2}', "c", "f"), row(1, 4, "user", "text", "é "),
        row(2, 0, "user", "text", "u"), row(2, 1, "system", "text", "late"), row(3, 0, "user", "tool_call", "{}", "c", "f"), row(4, 0, "robot", "text", "t"), row(5, 0, "user", "refused", None, error="$.x"), row(6, 0, "tool", "text", "t"), row(7, 0, "system", "text", "a"), row(7, 1, "developer", "text", "b"),
    ]
    made = turns.bodies_of(spark.createDataFrame(given, ROWS), protocol, F.lit("m")).collect()
    errors = {r["request_id"]: r["error"] for r in made}
    late = None if protocol == "responses" else "$.turns[1]"
    two = None if protocol in ("messages", "generate") else "$.turns[1]"
    assert errors == {1: None, 2: late, 3: "$.turns[0]", 4: "$.turns[0]", 5: "$.turns[0]", 6: "$.turns[0]", 7: two}
    assert all((r["body"] is None) == (r["error"] is not None) for r in made)
    body = json.loads(next(r["body"] for r in made if r["request_id"] == 1))
    assert ("max_tokens" in body) == (protocol == "messages") and body["model"] == "m"
    got = [r[1:] for r in read(spark, protocol, body)[0]]
    named = protocol in ("generate", "interactions")
    assert got == [("text", None, None, 'be "brief"\n', None), ("text", None, None, "a\\b", None), ("text", None, None, "x", None), ("tool_call", "c", "f", '{"q":[1]}', None), ("tool_result", "c", "f" if named else None, '{"r":2}', None), ("text", None, None, "é ", None)]
