import ipaddress
import re
import unicodedata

from pyspark.sql import functions as F

from veilframe.functions import canonical
from veilframe.operators import detect, mask, ratelimit, sse, wire
from veilframe.plans import patterns
from veilframe.streaming import ratelimit as stream_limit


def test_plain_characters_are_canonical():
    plain = re.compile(f"[{canonical.PLAIN}]")
    for c in filter(plain.match, map(chr, range(0x20000))):
        assert canonical.canonical(c)[0] == c and not unicodedata.combining(c), hex(ord(c))


def test_canonical_view_and_spans(spark):
    texts = ["plain", None, "", "ａ\u200bnn@exam\u00adple.com", "mail \uff41\u200bnn@example.com now", "e\u0301\u00a0ﬁ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r["i"]: r for r in detect.detect(df.withColumn("v", canonical.view(F.col("text")))).collect()}
    assert all(rows[k]["v"]["text"] is None for k in range(3))
    assert tuple(rows[5]["v"]) == ("é fi", [0, 2, 3, 3], [2, 3, 4, 4])
    (d,) = rows[4]["detections"]
    assert (d["entity_type"], d["start"], d["end"]) == ("EMAIL", 5, 21) and d["value"] == texts[4][5:21]


def test_ipv6_pattern(spark):
    texts = ["::1", "::", "1::", "fe80::1:2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3", "12345::1", "1:::2", "a::b::c", "1:2:3:4:5:6:7:8:9", "::g"]
    df = spark.createDataFrame([(f"<{t}>", t) for t in texts], "text string, t string")
    spec = patterns.NETWORK[0]
    got = {r["t"]: bool(r["m"]) for r in df.select("t", F.regexp_like("text", F.lit(spec.pattern)).alias("m")).collect()}

    def valid(t):
        try:
            return len(t) >= 3 and ipaddress.ip_address(t).version == 6
        except ValueError:
            return False

    assert got == {t: valid(t) for t in texts}


def test_sse(spark):
    lines = {
        1: [": hi", "event: x", "data: a", "data:b", "", "", "data:  c"],
        2: ["data: ok", "", "data: lost", "what: 1", "", "data: later"],
        3: ["data: ok", "", "nothing"],
        4: ["data: " + "x" * 60, "", "data: " + "y" * 60, ""],
    }
    df = spark.createDataFrame([(s, k, x) for s, v in lines.items() for k, x in enumerate(v)], "stream_id int, line_no int, line string")
    got = {(r["stream_id"], r["frame"], r["data"], r["error"]) for r in sse.frames(df, 100).collect()}
    assert got == {
        (1, 0, "a\nb", None), (1, 1, " c", None), (2, 0, "ok", None), (2, None, None, "unsupported_field"),
        (3, 0, "ok", None), (3, None, None, "malformed"), (4, 0, "x" * 60, None), (4, None, None, "too_large"),
    }


def test_rate_limit(spark):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, "a", at(0)), (2, "a", at(1.5)), (3, "a", at(2.5)), (4, "a", at(9.5)), (5, "a", at(10)), (6, None, at(3)), (7, None, at(3)), (8, None, at(3)), (9, "b", None)]
    df = spark.createDataFrame(rows, "request_id long, identity string, ts timestamp_ntz")
    got = {r["request_id"]: r["retry_after"] for r in ratelimit.limited(df, 2, 10).collect()}
    assert got == {1: None, 2: None, 3: 8, 4: 1, 5: None, 6: None, 7: None, 8: 10}
    assert ratelimit.limited(df.limit(0)).count() == 0


def test_rate_limit_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, "a", k * 1_000_000) for k in range(4)], "request_id long, identity string, us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_limit.limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 10).writeStream.format("memory").queryName("limited_t")
    query = query.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["request_id"]: r["retry_after"] for r in spark.table("limited_t").collect()} == {0: None, 1: None, 2: 8, 3: 7}


def test_wire(spark):
    token, other = "<MG:" + "A" * 26 + ">", "<MG:" + "B" * 26 + ">"
    cases = [
        ('{"model":"m","max_tokens":5,"x":true,"y":null}', None),
        ('{"a":{"b":[1]}}', "unclassified numeric value at $.a.b[0]"),
        (f'{{"t":"{token} fine"}}', None),
        (f'{{"t":"ok","u":"{other}"}}', "unrecognized token at $.u"),
        ('{"z":"ann@example.com","a":1}', "unapproved EMAIL at $.z"),
        ('{"z":"bob@example.com"}', None),
        ('{"ann@example.com":1}', "unapproved EMAIL at $.<key>"),
        ('{"c":"QUJDREVGR0hJSktMTU5PUFFSU1Q="}', "unsupported encoded content at $.c"),
        ('{"c":"%s"}' % ("0af1" * 8), "unsupported encoded content at $.c"),
        ('{"c":"ann%40example%2Ecom"}', "encoded EMAIL at $.c"),
        (r'{"c":"x \\u0061nn\\u0040example\\u002ecom"}', "encoded EMAIL at $.c"),
        (r'{"c":"{\"n\": 3}"}', "unclassified numeric value at $.c.<encoded-json>.n"),
        ("[1]", "provider payload is not a JSON object"),
        ("{", "provider payload is not a JSON object"),
        ('{"a":NaN}', "provider payload is not a JSON object"),
        (None, "provider payload is not a JSON object"),
    ]
    rows = [(i, b, "custom", [token], ["bob@example.com"]) for i, (b, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "request_id long, body string, provider string, tokens array<string>, values array<string>")
    got = {r["request_id"]: r["violation"] for r in wire.violations(df).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}


def test_unsafe_target(spark):
    rows = [("/v1/x", False), ("", False), (None, False), ("v1", True), ("/a/../b", True), ("/a\n", True), ("/" + "a" * 512, True)]
    df = spark.createDataFrame(rows, "t string, bad boolean")
    assert all(r["bad"] == r["got"] for r in df.withColumn("got", wire.unsafe_target(F.col("t"))).collect())


def test_output_guard(spark):
    token, other = "<MG:" + "A" * 26 + ">", "<MG:" + "B" * 26 + ">"
    rows = [(1, f"{token} and {other} and eve@example.com", [(token, "ann@example.com")]), (2, None, None), (3, "chat.completion", None)]
    df = spark.createDataFrame(rows, "i int, text string, pairs array<struct<replacement:string,original:string>>")
    got = {r["i"]: r["guarded"] for r in wire.guard_text(df).collect()}
    assert got == {1: "ann@example.com and [REDACTED_PROVIDER_TOKEN] and [REDACTED_PROVIDER_EMAIL]", 2: None, 3: "chat.completion"}
    kept = {r["i"]: r["guarded"] for r in wire.guard_text(df, restore=False).collect()}
    assert kept[1].startswith(token)


def test_what_overlaps_is_masked_and_comes_back(spark):
    """A phone number that ran into a card number; a token that is an IBAN by its letters; several rounds for one text."""
    token = "<MG:" + "IK26" + "A" * 22 + ">"
    texts = ["call +1 (208) 555-1177 4284896609045836", "no finding", None, "mail ann@example.com", "+1 (208) 555-1177 4284896609045836 +1 (208) 555-1178"]
    df = spark.createDataFrame([(k % 2 or None, k, t) for k, t in enumerate(texts)], "scope_id int, i int, text string")
    rows, table = mask.mask_all(detect.detect(df), key="demo")
    shown = {r["i"]: r["masked"] for r in rows.collect()}
    assert shown[1] == "no finding" and shown[2] is None
    assert not any(re.search("555-117|4284896609045836|ann@", t or "") for t in shown.values())
    assert table.groupBy("scope_id", "original").count().where("count > 1").isEmpty()
    got = {r["i"]: r["guarded"] for r in wire.guard_text(mask.scope_pairs(rows, table), "masked").collect()}
    assert got == dict(enumerate(texts))
    iban = spark.createDataFrame([(f"for {token}.", [(token, "ann@example.com")])], "text string, pairs array<struct<replacement:string,original:string>>")
    assert [d["entity_type"] for d in detect.detect(iban).first()["detections"]] == ["IBAN"]
    assert wire.guard_text(iban).first()["guarded"] == "for ann@example.com."


def test_vault_budget(spark):
    table = spark.createDataFrame([(1, k, "x" * 600, "r", True) for k in range(3)] + [(2, 0, "y", "r", True), (2, 1, "z", "r", True)], "scope_id int, pos int, original string, replacement string, restore boolean")
    got = sorted((r["scope_id"], r["error"] or "") for r in mask.over_budget(table, "pos", 5, 1300).collect())
    assert got == [(1, ""), (1, ""), (1, "capacity"), (2, ""), (2, "")]
    assert [tuple(r) for r in mask.collisions(table).collect()] == [(2, "r", 2)]


def test_looks_and_gates(spark):
    """A text is looked at once for what several patterns need, and whatever a pattern matches passes its look and gate."""
    texts = [
        "sk-" + "ſ" * 16, "RK-" + "a" * 16, "ghp_" + "a" * 20, "github_pat_" + "a" * 20, "xoxb-" + "a" * 10, "AKIA" + "A1" * 8, "aızA" + "b" * 20, "ИНН 7707083893", "СНИЛС 112-233-445 95", "паспорт 1234 567890",
        "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111", "+7 (495) 123-45-67", "10.0.0.1", "$5", "5 руб", "a.example.com", "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "١٢٣٤٥٦٧٨٩٠",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = detect.detect(df, plain=True, profile="STRICT")
    kinds = {r["i"]: [d["entity_type"] for d in r["detections"]] for r in found.collect()}
    assert all(kinds[k] == ["API_KEY"] for k in range(7)) and [kinds[k] for k in range(7, 14)] == [["INN"], ["SNILS"], ["PASSPORT"], ["IBAN"], ["CARD_NUMBER"], ["PHONE"], ["IP_ADDRESS"]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"(?U){p})") == 1 for p, _ in patterns.LOOKS.values())
    for spec in [*patterns.SECRETS, *patterns.STRUCTURED, patterns.BARE_PASSPORT, *patterns.NETWORK, *patterns.LEGACY]:
        look = patterns.LOOKS[spec.look][0] if spec.look else ""
        hit = df.where(F.col("text").rlike("(?U)" + spec.pattern))
        assert hit.where(~(F.col("text").rlike("(?U)" + look) & F.col("text").rlike("(?U)" + spec.gate) & F.col("text").contains(spec.cue))).isEmpty(), spec


def test_findings_as_rows_detect_once(spark, tmp_path):
    """No filter that Spark infers for the findings' rows is pushed into detection."""
    from veilframe import catalog

    df = spark.createDataFrame([(1, "mail ann@example.com"), (2, None), (3, "plain")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.detect_documents(spark, str(tmp_path))
    assert [(r["doc_id"], r["entity_type"], r["start"], r["end"]) for r in rows.collect()] == [(1, "EMAIL", 5, 20)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("://[^") <= 5  # a gate, a split and an extraction of connection strings, and those of others
