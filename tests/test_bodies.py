"""Hostile and awkward bodies: each has a defined result, and other rows are unharmed."""

import hashlib
import json

from veilframe.operators import bodies, wire

TOKEN, OTHER = "<MG:" + "A" * 26 + ">", "<MG:" + "B" * 26 + ">"
PAIRS = "request_id long, body string, pairs array<struct<replacement:string,original:string>>"


def test_hostile_bodies_are_violations(spark):
    refused = ['{"a":"\\ud800"}', '{"\\udc00":1}', '{"a":1e400}', '{"a":-1e999}', '{"a":Infinity}', '{"a":1,"a":2}', '{"x":[{"b":1,"b":"ann@example.com"}]}', "[" * 100_000, '{"a":' * 100_000]
    fine = ['{"a":"ok"}', '{"a":"\\ud83d\\ude00"}', '{"t":"x \\\\ud800 y"}', '{"t":"\\\\ud83d\\\\ude00 \\\\u0041\\\\udc00"}']
    rows = [(i, b, "custom", None, None) for i, b in enumerate(refused + fine)]
    df = spark.createDataFrame(rows, "request_id long, body string, provider string, tokens array<string>, values array<string>")
    got = {r["request_id"]: r["violation"] for r in wire.violations(df).collect()}
    assert all(got[k] == "provider payload is not a JSON object" for k in range(len(refused)))
    assert all(got[k] is None for k in range(len(refused), len(rows)))
    out = wire.guard_bodies(spark.createDataFrame([(i, b, None) for i, b, *_ in rows], PAIRS)).collect()
    for r in out:
        assert (r["rewritten"] is None) == (r["request_id"] < len(refused))
        if r["rewritten"]:
            assert json.loads(r["rewritten"]) == json.loads(r["body"])


def test_escapes_behind_halves_of_pairs_are_still_read(spark):
    rows = [(0, r'{"c":"\\ud800 \\u0061nn\\u0040example\\u002ecom"}', "custom", None, None)]
    df = spark.createDataFrame(rows, "request_id long, body string, provider string, tokens array<string>, values array<string>")
    assert wire.violations(df).first()["violation"] == "encoded EMAIL at $.c"


def guard_answer(spark, body, pairs=((TOKEN, "ann@example.com"),)):
    return wire.guard_bodies(spark.createDataFrame([(1, body, [tuple(p) for p in pairs])], PAIRS)).first()["rewritten"]


def test_guard_of_answers_in_four_passes(spark):
    cases = {
        f'{{"choices":[{{"message":{{"content":"{TOKEN} {OTHER} ann@example.com eve@example.com"}}}}]}}': '{"choices":[{"message":{"content":"ann@example.com [REDACTED_PROVIDER_TOKEN] [REDACTED_PROVIDER_EMAIL] [REDACTED_PROVIDER_EMAIL]"}}]}',
        f'{{"note":"{TOKEN}","id":{TOKEN!r}}}'.replace("'", '"'): '{"note":"[REDACTED_PROVIDER_TOKEN]","id":"[REDACTED_PROVIDER_TOKEN]"}',
        f'{{"choices":[{{"message":{{"content":[{{"text":"{TOKEN}","{TOKEN}":1.10}}]}}}}]}}': '{"choices":[{"message":{"content":[{"text":"ann@example.com","ann@example.com":1.10}]}}]}',
        '{"who@other.example":"v"}': '{"[REDACTED_PROVIDER_EMAIL]":"v"}',
        '{"a@other.example":1,"b@other.example":2}': None,
        '{"object":"chat.completion"}': '{"object":"chat.completion"}',
    }
    df = spark.createDataFrame([(i, b, [(TOKEN, "ann@example.com")]) for i, b in enumerate(cases)], PAIRS)
    got = {r["request_id"]: r["rewritten"] for r in wire.guard_bodies(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_restore_of_names(spark):
    cases = [f'{{"{TOKEN}":{{"x":"{TOKEN}{OTHER}"}}}}', f'{{"{TOKEN}":1,"ann":2}}', "nothing", None]
    df = spark.createDataFrame([(i, b, [(TOKEN, "ann")]) for i, b in enumerate(cases)], PAIRS)
    got = {r["request_id"]: r["rewritten"] for r in wire.restore_bodies(df).collect()}
    assert got == {0: f'{{"ann":{{"x":"ann{OTHER}"}}}}', 1: None, 2: None, 3: None}


def test_masked_names_stay_apart(spark):
    cases = [
        (1, 1, '{"model":"m-1","messages":[{"role":"user","content":"write ann@example.com"}],"ann@example.com":1.50,"bob@example.com":[2],"cat@example.com":3,"n":null}'),
        (2, 1, '{"model":"ann@example.com"}'),
        (3, 1, '{"messages":[{"role":"robot"}]}'),
        (4, None, '{"a":"a","a":"b"}'),
    ]
    df = spark.createDataFrame(cases, "request_id long, scope_id long, body string")
    got = {r["request_id"]: r["rewritten"] for r in bodies.mask_bodies(df, "redact")[0].collect()}
    mail = "[REDACTED_EMAIL]"
    assert got == {
        1: f'{{"model":"m-1","messages":[{{"role":"user","content":"write {mail}"}}],"{mail}":1.50,"{mail}__MGKEY_2":[2],"{mail}__MGKEY_3":3,"n":null}}',
        2: None, 3: None, 4: None,
    }
    rows, vault = bodies.mask_bodies(df.where("request_id = 1"), "placeholder", key="k")
    back = rows.select("request_id", "rewritten").first()["rewritten"]
    pairs = [(r["replacement"], r["original"]) for r in vault.collect()]
    assert len(pairs) == 3 and "example.com" not in back
    assert wire.restore_bodies(spark.createDataFrame([(1, back, pairs)], PAIRS)).first()["rewritten"] == cases[0][2]


def test_sealed_bytes(spark):
    rows = [(1, '{ "t" : "\\u00e9" , "max_tokens" : 5 }', "custom"), (1, '{"t":"ann@example.com"}', "custom"), (3, "[]", "custom"), (4, None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "request_id long, body string, provider string, tokens array<string>, values array<string>")
    got = sorted(((r["request_id"], r["sealed"] or "", r["sha256"] or "", r["violation"] or "") for r in wire.sealed(df).collect()))
    text = '{"t":"é","max_tokens":5}'
    bad = "provider payload is not a JSON object"
    assert got == [(1, "", "", "unapproved EMAIL at $.t"), (1, text, hashlib.sha256(text.encode()).hexdigest(), ""), (3, "", "", bad), (4, "", "", bad)]


def test_carried_columns_stay_arrows(spark):
    """Columns beside a body go with each of its leaves as they are, without Python values made of them."""
    rows = [(1, '{"a":"x","b":[1,null]}', [("r", "o"), ("r2", None)]), (None, "no", None), (3, "{}", []), (4, None, [])]
    df = spark.createDataFrame(rows, "request_id int, body string, pairs array<struct<replacement:string,original:string>>")
    made = wire.flatten(df, carry=("pairs",))
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["request_id"], r["ordinal"], r["path"], r["kind"], r["text"], None if r["pairs"] is None else [tuple(p) for p in r["pairs"]]) for r in made.collect()]
    pairs = rows[0][2]
    assert sorted(got, key=str) == sorted([
        (1, 0, "$.<key>", "key", "a", pairs), (1, 1, "$.a", "string", "x", pairs), (1, 2, "$.<key>", "key", "b", pairs), (1, 3, "$.b[0]", "number", "1", pairs), (1, 4, "$.b[1]", "other", None, pairs),
        (None, 0, "$", "invalid", None, None), (4, 0, "$", "invalid", None, []),
    ], key=str)
