"""Policy files as tables: one JSON document a file (which a YAML reader reads as well), read strictly.

A document with a member twice is no document. Files are read whole by Spark; their rules and
assertions become the rows that the checks of :mod:`..operators.policy` read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy

# Members of a policy file.
VERSION = 2
ROOT = ("version", "defaults", "rules", "public_data_assertions")
DEFAULTS = ("action", "reason", "obligations")
RULE = ("id", "priority", "action", "reason", "obligations", "conditions")
ASSERTION = ("id", "entity_type", "value_sha256", "action", "reason", "obligations", "scope", "expires_at", "provenance")
# Fixed values end.
#: The context column that a list of a rule's conditions is held against.
COLUMNS = {n: n[:-3] + "y" if n.endswith("ies") else n[:-2] if n.endswith("sses") else n[:-1] for n in policy.LISTS if n != "json_paths"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, document (a variant; null for what is no JSON or holds a member twice) of each file at ``path``; a file without a byte has no row."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("document"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0), F.lit(""))


def _at(v: Column, member: str) -> Column:
    return F.try_variant_get(v, f"$.{member}", "variant")


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "double"))


def _strings(v: Column) -> Column:
    """A list's strings, with null for other members; anything but a list is an empty one, null and absent are null."""
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), _string)
    return F.when(_kind(v) == "ARRAY", listed).when(v.isNotNull() & (_kind(v) != "VOID"), F.array().cast("array<string>"))


def _members(v: Column) -> Column:
    """An object's members; null and absent have none, anything else has one that no object may have."""
    none = F.create_map().cast("map<string,variant>")
    wrong = F.map_from_arrays(F.array(F.lit("")), F.array(v))
    return F.when(_kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>")).when(v.isNull() | (_kind(v) == "VOID"), none).otherwise(wrong)


def _unknown(v: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(_members(v)), F.array(*map(F.lit, allowed)))) > 0


def errors(documents: DataFrame) -> DataFrame:
    """file, ``error``: the first fault of each document outside its rules' and assertions' members."""
    d = F.col("document")
    defaults = _at(d, "defaults")
    listed = lambda n: ~_kind(_at(d, n)).isin("ARRAY", "")
    within = lambda n, allowed: F.exists(F.coalesce(F.try_variant_get(d, f"$.{n}", "array<variant>"), F.array().cast("array<variant>")), lambda r: (_kind(r) != "OBJECT") | _unknown(r, allowed))
    checks = [
        (_kind(d) != "OBJECT", "no object of JSON, or a member twice"),
        (_unknown(d, ROOT), "unknown member"),
        (~F.coalesce(_number(_at(d, "version")) == VERSION, F.lit(False)), f"version: not {VERSION}"),
        ((_kind(defaults) != "OBJECT") | _unknown(defaults, DEFAULTS), "defaults: missing, or unknown member"),
        (~F.coalesce(_string(_at(defaults, "action")).isin(*policy.DENYING), F.lit(False)), "defaults.action: does not deny"),
        (F.coalesce(F.trim(_string(_at(defaults, "reason"))) == "", F.lit(True)), "defaults.reason: empty"),
        (listed("rules"), "rules: no list"),
        (listed("public_data_assertions"), "public_data_assertions: no list"),
        (within("rules", RULE), "rules: one is no object or has an unknown member"),
        (within("public_data_assertions", ASSERTION), "public_data_assertions: one is no object or has an unknown member"),
    ]
    out = F.lit(None).cast("string")
    for test, said in reversed(checks):
        out = F.when(test, said).otherwise(out)
    return documents.select("file", out.alias("error")).where("error is not null")


def rules(documents: DataFrame) -> DataFrame:
    """The rules of documents as ``policy.rule_errors`` reads them, with their file.

    Bounds are members of ``ranges``, all others of ``conditions``; a bound that is no number is
    not a bound that a rule may have.
    """
    each = documents.select("file", F.posexplode(F.try_variant_get("document", "$.rules", "array<variant>")).alias("position", "r"))
    r = F.col("r")
    bounds = [f"{e}_{n}" for n in policy.RANGES for e in ("min", "max")]
    given = each.withColumn("m", _members(_at(r, "conditions")))
    numeric = lambda k, v: k.isin(*bounds) & _number(v).isNotNull()
    return given.select(
        "file", "position", _string(_at(r, "id")).alias("id"), _number(_at(r, "priority")).alias("priority"), _string(_at(r, "action")).alias("action"), _string(_at(r, "reason")).alias("reason"),
        _strings(_at(r, "obligations")).alias("obligations"),
        F.transform_values(F.map_filter("m", lambda k, v: ~numeric(k, v)), lambda k, v: _strings(v)).alias("conditions"),
        F.transform_values(F.map_filter("m", numeric), lambda k, v: _number(v)).alias("ranges"),
    )


def assertions(documents: DataFrame) -> DataFrame:
    """The public assertions of documents as ``policy.assertion_errors`` reads them, with their file."""
    each = documents.select("file", F.posexplode(F.try_variant_get("document", "$.public_data_assertions", "array<variant>")).alias("position", "a"))
    a = F.col("a")
    texts = [_string(_at(a, n)).alias(n) for n in ASSERTION if n not in ("scope", "obligations")]
    scope = F.when(_kind(_at(a, "scope")) == "OBJECT", F.transform_values(_members(_at(a, "scope")), lambda k, v: _strings(v)))
    return each.select("file", "position", *texts, _strings(_at(a, "obligations")).alias("obligations"), scope.alias("scope"))


def load(spark: SparkSession, path: str) -> policy.Policy:
    """The policy of one file; ValueError names its first fault. A file has at most ``policy.MOST_RULES`` rules."""
    documents = read(spark, path).cache()
    try:
        if documents.count() != 1:
            raise ValueError("a policy is one file")
        found = rules(documents)
        for faults in (errors(documents), policy.rule_errors(found).orderBy("position"), policy.assertion_errors(assertions(documents)).orderBy("position")):
            first = faults.first()
            if first is not None:
                raise ValueError(first["error"])
        rows = found.limit(policy.MOST_RULES + 1).collect()
        if len(rows) > policy.MOST_RULES:
            raise ValueError(f"over {policy.MOST_RULES} rules")
        default = documents.select(F.try_variant_get("document", "$.defaults.action", "string")).first()[0]
    finally:
        documents.unpersist()
    made = []
    for r in rows:
        held = {k: tuple(x.strip() for x in v) for k, v in r["conditions"].items()}
        held = {k: tuple(x.upper() for x in v) if k == "entity_types" else v for k, v in held.items()}
        low_high = {k: int(v) if k.endswith("risk_score") else v for k, v in r["ranges"].items()}
        paths = held.pop("json_paths", ())
        made.append(policy.Rule(r["id"].strip(), int(r["priority"]), r["action"], {COLUMNS[k]: v for k, v in held.items()}, paths, **{f"{k}": v for k, v in low_high.items()}))
    return policy.Policy(tuple(made), default)
