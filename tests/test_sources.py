import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators import policy
from veilframe.sources import files, policies

GOOD = {
    "version": 2,
    "defaults": {"action": "BLOCK", "reason": "else"},
    "rules": [
        {"id": "mail", "priority": 10, "action": "TOKENIZE", "reason": "r", "conditions": {"entity_types": ["email"], "data_classes": ["DIRECT_PII"], "min_confidence": 0.5, "json_paths": ["messages.*"]}},
        {"id": "any", "priority": 5, "action": "REDACT", "reason": "r", "obligations": ["log"]},
    ],
    "public_data_assertions": [
        {"id": "a", "entity_type": "ORG", "value_sha256": "0" * 64, "action": "ALLOW", "reason": "r", "provenance": "p", "expires_at": "2999-01-01T00:00:00Z",
         "scope": {"tenants": ["t"], "applications": ["a"], "directions": ["INPUT"], "providers": ["p"], "purposes": ["x"]}},
    ],
}


def test_policy_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(GOOD, indent=1))
    made = policies.load(spark, str(path))
    assert made.default == "BLOCK" and [r.id for r in made.rules] == ["mail", "any"]
    assert made.rules[0] == policy.Rule("mail", 10, "TOKENIZE", {"entity_type": ("EMAIL",), "data_class": ("DIRECT_PII",)}, ("messages.*",), min_confidence=0.5)
    rows = spark.createDataFrame([("EMAIL", "DIRECT_PII", 0.6, "messages.0"), ("EMAIL", "DIRECT_PII", 0.4, "messages.0"), ("EMAIL", "DIRECT_PII", 0.6, "x")], "entity_type string, data_class string, confidence double, json_path string")
    assert [r["action"] for r in policy.decide(rows, made).collect()] == ["TOKENIZE", "REDACT", "REDACT"]


def test_columns_of_conditions():
    assert {policies.COLUMNS[n] for n in ("entity_types", "data_classes", "risk_buckets", "roles")} == {"entity_type", "data_class", "risk_bucket", "role"}


def test_faults_of_policy_files(spark, tmp_path):
    text = json.dumps(GOOD)
    rule = lambda **k: json.dumps(GOOD | {"rules": [GOOD["rules"][1] | k]})
    faulty = {
        "twice": (text.replace('"version": 2', '"version": 2, "version": 2'), "twice"),
        "deep": (text.replace('"reason": "else"', '"reason": "else", "reason": "x"'), "twice"),
        "none": (" ", "no object"), "list": ("[]", "no object"), "root": (json.dumps(GOOD | {"x": 1}), "unknown member"), "version": (json.dumps(GOOD | {"version": "2"}), "version"),
        "allow": (json.dumps(GOOD | {"defaults": {"action": "ALLOW", "reason": "r"}}), "defaults.action"), "rules": (json.dumps(GOOD | {"rules": {}}), "rules: no list"), "member": (rule(colour="red"), "unknown member"),
    }
    for name, (body, _) in faulty.items():
        (tmp_path / name).write_text(body)
    got = {r["file"].rsplit("/", 1)[1]: r["error"] for r in policies.errors(policies.read(spark, str(tmp_path))).collect()}
    assert got.keys() == faulty.keys() and all(part in got[n] for n, (_, part) in faulty.items()), got
    (tmp_path / "rule").mkdir()
    for i, (change, part) in enumerate([({"priority": "5"}, "missing"), ({"conditions": []}, "unknown member"), ({"conditions": {"roles": "user"}}, "no members"), ({"conditions": {"roles": [1]}}, "an empty member"), ({"conditions": {"min_confidence": "a"}}, "unknown member"), ({"id": 5}, "empty")]):
        path = tmp_path / "rule" / str(i)
        path.write_text(rule(**change))
        with pytest.raises(ValueError, match=part):
            policies.load(spark, str(path))


def test_kinds_of_files(spark, tmp_path):
    given = {
        "a.docx": (b"PK\x03\x04x", "docx", None), "b.DOCX": (b"PK", "docx", None), "c.zip": (b"PK\x03\x04", None, "unsupported"), "d.txt": (b"%PDF-1.7", "pdf", None), "e": (b"\x89PNG\r\n\x1a\nx", "png", None),
        "f": (b"\xff\xd8\xff\xe0", "jpeg", None), "g": (b"MM\x00*", "tiff", None), "h": (b"RIFF1234WEBPx", "webp", None), "i": (b"RIFF1234WAVE", None, "unsupported"), "k": (b"BM" + b"x" * 200, None, "too large"), "l": (b"%PDF", None, "unsupported"),
    }
    for name, (content, _, _) in given.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["error"]) for r in files.read(spark, str(tmp_path), 100).collect()}
    assert got == {n: (k, e) for n, (_, k, e) in given.items()}
    rows = spark.createDataFrame([(b"", "a.docx", None), (None, None, None), (b"PK", None, files.DOCX_TYPE), (b"PK", ".docx", "x")], "c binary, n string, t string")
    assert [tuple(r[0]) for r in rows.select(files.kind(F.col("c"), F.col("n"), F.col("t"))).collect()] == [(None, "empty"), (None, "empty"), ("docx", None), (None, "unsupported")]
