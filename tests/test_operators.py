import pathlib

from veilframe import catalog
from veilframe.functions import validators
from veilframe.operators import conversations, detect, mask, metrics, policy, risk

from pyspark.sql import functions as F


def types(spark, texts, profile="BALANCED"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    rows = detect.detect(df, profile=profile).orderBy("i").collect()
    return [[(d["entity_type"], d["value"], r["text"][d["start"] : d["end"]]) for d in r["detections"]] for r in rows]


def test_detection(spark):
    got = types(
        spark,
        [
            None,
            "",
            "😀 write to ann.lee@example.com, or call +1 (202) 555-0171.",
            "card 4111 1111 1111 1111 and 4111 1111 1111 1112",
            "ИНН 7707083893 СНИЛС 112-233-445 95 паспорт 4510 123456",
            "IBAN DE89 3704 0044 0532 0130 00 host 10.0.0.1 see https://a.example/x",
            "postgres://user:pw@db.example.com/main -----BEGIN RSA PRIVATE KEY-----",
            "password = abcdefghijkl123",
        ],
    )
    assert all(value == text for row in got for _, value, text in row)
    names = [[n for n, *_ in row] for row in got]
    assert names[0] == names[1] == []
    assert names[2] == ["EMAIL", "PHONE"]
    assert names[3][0] == "CARD_NUMBER" and names[3].count("CARD_NUMBER") == 1
    assert names[4] == ["INN", "SNILS", "PASSPORT"]
    assert names[5] == ["IBAN", "IP_ADDRESS", "URL"]
    assert names[6] == ["CONNECTION_STRING", "PRIVATE_KEY"]
    assert names[7] == ["API_KEY"]


def test_equal_spans_merge(spark):
    row = detect.detect(spark.createDataFrame([("ИНН 7707083893",)], "text string")).first()["detections"][0]
    assert (row["recognizer"], row["confidence"]) == ("structured-identifiers+legacy-regex", 1.0)


def test_validators(spark):
    values = [("4111111111111111", 1, 0, 0, 0), ("7707083893", 0, 1, 0, 0), ("500100732259", 0, 1, 0, 0), ("112-233-445 95", 0, 0, 1, 0), ("DE89370400440532013000", 0, 0, 0, 1), ("", 0, 0, 0, 0), (None, 0, 0, 0, 0)]
    df = spark.createDataFrame(values, "v string, a int, b int, c int, d int")
    v = F.col("v")
    for r in df.select("*", validators.luhn(v).alias("w"), validators.inn(v).alias("x"), validators.snils(v).alias("y"), validators.iban(v).alias("z")).collect():
        assert [r["w"], r["x"], r["y"], r["z"]] == [bool(r[k]) for k in "abcd"], r


def test_risk(spark):
    df = spark.createDataFrame([(1, "mail ann@example.com at 10.0.0.1"), (2, "nothing")], "i int, text string")
    rows = detect.detect(df).select("i", risk.assess(F.col("detections")).alias("r")).orderBy("i").collect()
    assert (rows[0]["r"]["score"], rows[0]["r"]["bucket"]) == (58 + 12 + 2, "HIGH")
    assert rows[1]["r"].asDict() == {"score": 0, "bucket": "LOW", "signals": ["no_sensitive_signals"]}


def test_policy(spark):
    p = policy.Policy((policy.Rule("a", 2, "ALLOW", {"role": ("user",)}), policy.Rule("b", 5, "BLOCK", json_paths=("messages.*.secret",))))
    rows = [("user", "messages.0.secret", False), ("user", "x", True), ("user", "x", False), (None, "x", False), (None, "x", True)]
    got = policy.decide(spark.createDataFrame(rows, "role string, json_path string, public boolean"), p, F.col("public")).collect()
    assert [(r["action"], r["rule_id"]) for r in got] == [("BLOCK", "b"), ("ALLOW", None), ("ALLOW", "a"), ("BLOCK", None), ("ALLOW", None)]


def test_assertion_scope(spark):
    """An assertion holds in its own scope only; open sets let everything through; rows never multiply."""
    import duckdb

    context = dict(entity_type="person", value="Ann  Lee", tenant="t", application="a", direction="d", provider="p", purpose="u", route="r", model="m", jurisdiction="j")
    rows = [context] + [context | {c: "other"} for c, _ in policy.SCOPE + policy.OPEN_SCOPE] + [context | {"tenant": None}]
    df = spark.createDataFrame(rows)
    scope = "struct<" + ",".join(f"{s}:array<string>" for _, s in policy.SCOPE + policy.OPEN_SCOPE) + ">"
    sha = df.select(policy.digest(F.lit("PERSON"), F.lit("ann lee"))).first()[0]
    made = lambda *open_, day="2999-01-01": spark.createDataFrame([("PERSON", sha, (["t"], ["a"], ["d"], ["p"], ["u"], *open_), day)] * 2, f"entity_type string, value_sha256 string, scope {scope}, day string").withColumn("expires_at", F.col("day").cast("timestamp"))
    count = lambda a: [policy.asserted(df, a).count(), policy.asserted(df, a).where("public").count()]
    assert count(made(["r"], ["m"], ["j"])) == [10, 1]
    assert count(made([], None, [])) == [10, 4]
    assert count(made([], [], [], day="2000-01-01")) == [10, 0]
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{folder}/customer.parquet'")
    got = catalog.queries()["policy_asserted"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()["policy_asserted"]).fetchall()) and {r["action"] for r in got} == {"ALLOW", "TOKENIZE"}


def test_mask_and_restore(spark):
    import base64
    import hashlib
    import re

    df = spark.createDataFrame([(1, "a@b.example and c@d.example, a@b.example again"), (2, "none"), (3, None)], "scope_id long, text string")
    found = detect.detect(df)
    rows, table = mask.mask(found, "semantic_placeholder")
    got = {r["scope_id"]: r["masked"] for r in rows.collect()}
    assert got == {1: "<MG_r_EMAIL_1> and <MG_r_EMAIL_2>, <MG_r_EMAIL_1> again", 2: "none", 3: None}
    rows, table = mask.mask(found, "placeholder", "k")
    want = base64.b32encode(hashlib.sha256(b"k\0001\0a@b.example").digest()[:16]).decode().rstrip("=")
    token = next(r["replacement"] for r in table.collect() if r["original"] == "a@b.example")
    assert token == f"<MG:{want}>" and re.fullmatch(mask.OPAQUE, token)
    assert {r["scope_id"]: r["restored"] for r in mask.restore(rows, table).collect()} == {r["scope_id"]: r["text"] for r in df.collect()}


def test_surrogates(spark):
    """The reference's templates, and title case that keeps underscores."""
    want = {
        ("PERSON", 1): "Demo Person 1", ("ORG", 2): "Example Organization 2", ("EMAIL", 3): "demo.3@example.test", ("PHONE", 12_345): "+1 202-555-2345 ext 12345",
        ("IP_ADDRESS", 253): "198.51.0.254", ("IP_ADDRESS", 254): "198.51.1.1", ("IP_ADDRESS", 254 * 254): "198.51.0.1", ("DOMAIN", 4): "demo-4.example.test",
        ("URL", 5): "https://example.test/resource/5", ("API_KEY", 6): "sk-test-synthetic-000000000000000000000006", ("FILE_PATH", 7): r"C:\Example\Synthetic\file-7.txt",
        ("MONEY", 1_234_567): "$1,234,567.00", ("CARD_NUMBER", 12_345): "0000 0000 0001 2345", ("BANK", 8): "Example Bank 8", ("LOCATION", 9): "Example Location 9",
        ("PRIVATE_KEY", 1): "Synthetic Private_Key 1", ("X509_CERT", 2): "Synthetic X509_Cert 2",
    }
    df = spark.createDataFrame(list(want), "t string, n int")
    assert {(r["t"], r["n"]): r["s"] for r in df.select("t", "n", mask.surrogate(F.col("t"), F.col("n")).alias("s")).collect()} == want
    found = spark.createDataFrame([(1, "EMAIL", "a@b.example", 0), (1, "EMAIL", "c@d.example", 20), (2, "EMAIL", "c@d.example", 3)], "scope_id long, entity_type string, value string, pos int")
    assert {(r["scope_id"], r["original"]): r["replacement"] for r in mask.vault(found, "surrogate").collect()} == {(1, "a@b.example"): "demo.1@example.test", (1, "c@d.example"): "demo.2@example.test", (2, "c@d.example"): "demo.1@example.test"}
    assert "mask_surrogate" in catalog.queries()


def test_trim_by_chars_follows_the_loop(spark):
    history = [(1, 0, "system", "s" * 30), (1, 1, "user", "a" * 50), (1, 2, "assistant", "b" * 40), (1, 3, "user", "c" * 10), (2, 0, "user", "x" * 500)]
    df = spark.createDataFrame(history, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]) for r in conversations.trim_by_chars(df, 85).collect()}
    assert got == {(1, 0), (1, 2), (1, 3), (2, 0)}


def test_quality(spark):
    e = spark.createDataFrame([("a", "EMAIL", 0, 3), ("a", "EMAIL", 5, 9)], "case_id string, entity_type string, start int, end int")
    p = spark.createDataFrame([("a", "EMAIL", 0, 3), ("a", "JWT", 0, 1)], "case_id string, entity_type string, start int, end int")
    got = {r["entity_type"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.quality(e, p).collect()}
    assert got == {"EMAIL": (1, 0, 1), "JWT": (0, 1, 0)}


def test_sql_twins(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    show = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    for name, sql in catalog.oracle_sql().items():
        got, want = catalog.queries()[name](spark, folder), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        assert sorted(map(show, got.select(want.columns).collect())) == sorted(map(show, want.fetchall())), name
