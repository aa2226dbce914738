"""Contextual policy: prioritised rules, first match, with public assertions and a default."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Actions, and the members of a scope.
ACTIONS = ("ALLOW", "TOKENIZE", "SURROGATE", "REDACT", "GENERALIZE", "HASH", "BLOCK", "REQUIRE_REVIEW")
DENYING = ("BLOCK", "REQUIRE_REVIEW")
#: Context column and scope field; the first five must hold the context, the others only if they list anything.
SCOPE = (("tenant", "tenants"), ("application", "applications"), ("direction", "directions"), ("provider", "providers"), ("purpose", "purposes"))
OPEN_SCOPE = (("route", "routes"), ("model", "models"), ("jurisdiction", "jurisdictions"))
# Fixed values end.
#: A table of more rules is refused, as they become one expression.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """``conditions`` maps context columns to allowed values; ``json_paths`` are globs."""

    id: str
    priority: int
    action: str
    conditions: dict[str, tuple] = field(default_factory=dict)
    json_paths: tuple[str, ...] = ()
    min_confidence: float | None = None
    max_confidence: float | None = None
    min_risk_score: int | None = None
    max_risk_score: int | None = None


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...]
    default: str = "BLOCK"

    def __post_init__(self):
        for name in ("id", "priority"):
            values = [getattr(r, name) for r in self.rules]
            if len(values) != len(set(values)):
                raise ValueError(f"rules share a {name}")
        if any(r.action not in ACTIONS for r in self.rules):
            raise ValueError("unknown action")
        if self.default not in DENYING:
            raise ValueError("the default must deny")


def glob(pattern: str) -> str:
    """A case-sensitive glob (* ? [...]; * crosses dots) as a Java regular expression."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        k += 1
    return rf"(?s)\A{out}\z"


def matches(rule: Rule) -> Column:
    """Whether a context row meets all conditions; none means any row."""
    tests = [F.col(c).isin(*values) for c, values in rule.conditions.items() if values]
    if rule.json_paths:
        tests.append(F.lit(False) if not rule.json_paths else _any([F.col("json_path").rlike(glob(g)) for g in rule.json_paths]))
    for name, low, high in (("confidence", rule.min_confidence, rule.max_confidence), ("risk_score", rule.min_risk_score, rule.max_risk_score)):
        tests += [F.col(name) >= low] if low is not None else []
        tests += [F.col(name) <= high] if high is not None else []
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def decide(df: DataFrame, policy: Policy, asserted: Column | None = None) -> DataFrame:
    """``df`` plus action and rule_id: a denying first match, an assertion, another match, the default.

    Rules are few and become one CASE in order of priority, so deciding needs no join.
    """
    rule = action = None
    for r in sorted(policy.rules, key=lambda r: -r.priority):
        test = matches(r)
        rule = F.when(test, r.id) if rule is None else rule.when(test, r.id)
        action = F.when(test, r.action) if action is None else action.when(test, r.action)
    rule, action = (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, action)
    yes = F.lit(False) if asserted is None else F.coalesce(asserted, F.lit(False))
    out = df.withColumns({"_rule": rule, "_action": action, "_public": yes})
    public = F.col("_public") & ~F.coalesce(F.col("_action").isin(*DENYING), F.lit(False))
    return out.withColumns(
        {
            "action": F.when(public, "ALLOW").otherwise(F.coalesce("_action", F.lit(policy.default))),
            "rule_id": F.when(public, F.lit(None)).otherwise(F.col("_rule")),
        }
    ).drop("_rule", "_action", "_public")


def digest(entity_type: Column, value: Column) -> Column:
    """SHA-256 of type, NUL and the normalised value, as public assertions name values.

    Persons' white space is collapsed. Case is folded by ``lower``, as is right for ASCII.
    """
    normal = F.lower(F.trim(F.when(F.upper(entity_type) == "PERSON", F.regexp_replace(value, r"(?U)\s+", " ")).otherwise(value)))
    return F.sha2(F.concat(F.upper(entity_type), F.lit("\0"), normal), 256)


def asserted(df: DataFrame, assertions: DataFrame) -> DataFrame:
    """``df`` (entity_type, value and the context columns) plus ``public``: a live assertion names the value in this scope.

    ``assertions`` has entity_type, value_sha256, expires_at and ``scope``, a struct of sets. The
    scopes of a value become one array, so no row of ``df`` multiplies.
    """
    live = assertions.where(F.col("expires_at") > F.current_timestamp())
    scopes = live.groupBy(F.col("entity_type").alias("a_type"), F.col("value_sha256").alias("a_sha")).agg(F.collect_set("scope").alias("a_scopes"))
    keyed = df.withColumn("_sha", digest(F.col("entity_type"), F.col("value")))
    hit = keyed.join(scopes, (F.upper("entity_type") == F.col("a_type")) & (F.col("_sha") == F.col("a_sha")), "left")

    def fits(scope: Column) -> Column:
        out = F.lit(True)
        for context, allowed in SCOPE:
            out = out & F.coalesce(F.array_contains(scope[allowed], F.col(context)), F.lit(False))
        for context, allowed in OPEN_SCOPE:
            empty = F.coalesce(F.size(scope[allowed]) <= 0, F.lit(True))
            out = out & (empty | F.coalesce(F.array_contains(scope[allowed], F.col(context)), F.lit(False)))
        return out

    return hit.withColumn("public", F.coalesce(F.exists("a_scopes", fits), F.lit(False))).drop("_sha", "a_type", "a_sha", "a_scopes")


# What a policy file may say.
ENTITY_TYPES = (
    "API_KEY", "URL", "EMAIL", "FILE_PATH", "CARD_NUMBER", "INN", "PHONE", "IP_ADDRESS", "MONEY", "DOMAIN", "PERSON", "ORG", "LOCATION", "BANK", "SNILS", "PASSPORT",
    "ACCOUNT_NUMBER", "ADDRESS", "BIC", "CONNECTION_STRING", "DATE_OF_BIRTH", "IBAN", "IPV6", "JWT", "PASSWORD", "PRIVATE_KEY", "SWIFT",
)
PUBLIC_TYPES = ("DOMAIN", "EMAIL", "LOCATION", "ORG", "PERSON", "URL")
CHOICES = {
    "data_classes": ("PUBLIC_DATA", "QUASI_IDENTIFIER", "LOCATION", "BUSINESS_CONFIDENTIAL", "DIRECT_PII", "FINANCIAL", "HEALTH", "AUTH_SECRET"),
    "directions": ("INPUT", "OUTPUT"),
    "token_scopes": ("field", "request", "turn", "conversation", "tenant"),
    "risk_buckets": ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
}
LISTS = ("entity_types", "data_classes", "tenants", "applications", "routes", "directions", "providers", "models", "jurisdictions", "purposes", "json_paths", "roles", "recognizers", "token_scopes", "risk_buckets")
RANGES = {"confidence": 1.0, "risk_score": 100.0}
MOST_PRIORITY = 1_000_000
# Fixed values end.


def rule_errors(rules: DataFrame) -> DataFrame:
    """position and ``error`` of the rules of a policy file that must not be loaded.

    ``rules`` has position, id, priority (double), action, reason, obligations (array), conditions
    (map<string, array<string>>) and ranges (map<string, double>, such as min_confidence). A rule
    has the first of its own faults, else an id or a priority that an earlier rule has.
    """
    where = F.concat(F.lit("rules["), F.col("position").cast("string"), F.lit("]"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    checks = [
        (blank("id"), ".id: empty"),
        (F.col("priority").isNull(), ".priority: missing"),
        (F.col("priority") != F.floor("priority"), ".priority: not whole"),
        (~F.col("priority").between(0, MOST_PRIORITY), f".priority: not in 0..{MOST_PRIORITY}"),
        (blank("reason"), ".reason: empty"),
        *_list_checks(F.col("obligations"), ".obligations"),
        (F.size(F.array_except(F.map_keys("conditions"), F.array(*map(F.lit, LISTS)))) > 0, ".conditions: unknown member"),
        (F.size(F.array_except(F.map_keys("ranges"), F.array(*(F.lit(f"{e}_{n}") for n in RANGES for e in ("min", "max"))))) > 0, ".conditions: unknown member"),
    ]
    bounds = lambda n: (F.try_element_at("ranges", F.lit(f"min_{n}")), F.try_element_at("ranges", F.lit(f"max_{n}")))
    for n, most in RANGES.items():
        for end, value in zip(("min", "max"), bounds(n)):
            if n == "risk_score":
                checks.append((value != F.floor(value), f".conditions.{end}_{n}: not whole"))
            checks.append((~value.between(0, most), f".conditions.{end}_{n}: not in 0..{most:g}"))
    for n in RANGES:
        low, high = bounds(n)
        checks.append((low > high, f".conditions: least {n} over the most"))
    for n in LISTS:
        listed = F.try_element_at("conditions", F.lit(n))
        checks += _list_checks(listed, f".conditions.{n}")
        if n == "entity_types":
            upper = F.transform(listed, lambda x: F.upper(F.trim(x)))
            checks.append((F.size(F.array_distinct(upper)) < F.size(listed), f".conditions.{n}: one type twice"))
            checks.append((F.size(F.array_except(upper, F.array(*map(F.lit, ENTITY_TYPES)))) > 0, f".conditions.{n}: unknown type"))
        elif n in CHOICES:
            checks.append((F.size(F.array_except(F.transform(listed, F.trim), F.array(*map(F.lit, CHOICES[n])))) > 0, f".conditions.{n}: unknown value"))
    checks.append((~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), ".action: unknown value"))
    own = _first(checks, where)
    judged = rules.select("position", F.trim("id").alias("id"), "priority", own.alias("own"))
    for n in ("id", "priority"):
        first = judged.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("position").alias(f"first_{n}"))
        judged = judged.join(first, n, "left")
    again = F.when(F.col("first_id") < F.col("position"), F.concat(where, F.lit(".id: taken"))).when(F.col("first_priority") < F.col("position"), F.concat(where, F.lit(".priority: taken")))
    return judged.select("position", F.coalesce("own", again).alias("error")).where("error is not null")


def assertion_errors(assertions: DataFrame) -> DataFrame:
    """position and ``error`` of public assertions that must not be loaded; the first fault counts.

    ``assertions`` has position, id, entity_type, value_sha256, action, reason, provenance,
    obligations (array), scope (map<string, array<string>>) and expires_at (text with a time zone).
    """
    where = F.concat(F.lit("public_data_assertions["), F.col("position").cast("string"), F.lit("]"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    fields = [f for _, f in (*SCOPE, *OPEN_SCOPE)]
    checks = [
        (blank("entity_type"), ".entity_type: empty"),
        (~F.upper(F.trim("entity_type")).isin(*PUBLIC_TYPES), ".entity_type: never public"),
        (~F.coalesce(F.lower(F.trim("value_sha256")).rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), ".value_sha256: no SHA-256 in hex"),
        (F.coalesce(F.col("action") != "ALLOW", F.lit(True)), ".action: not ALLOW"),
        (F.col("scope").isNull(), ".scope: missing"),
        (F.size(F.array_except(F.map_keys("scope"), F.array(*map(F.lit, fields)))) > 0, ".scope: unknown member"),
    ]
    for _, n in SCOPE:
        checks.append((F.try_element_at("scope", F.lit(n)).isNull(), f".scope.{n}: missing"))
    for n in fields:
        listed = F.try_element_at("scope", F.lit(n))
        checks += _list_checks(listed, f".scope.{n}")
        if n in CHOICES:
            checks.append((F.size(F.array_except(F.transform(listed, F.trim), F.array(*map(F.lit, CHOICES[n])))) > 0, f".scope.{n}: unknown value"))
    checks += [(blank("id"), ".id: empty"), (blank("reason"), ".reason: empty"), *_list_checks(F.col("obligations"), ".obligations")]
    checks.append((F.try_to_timestamp("expires_at").isNull(), ".expires_at: no time"))
    checks.append((~F.col("expires_at").rlike(r"(?:Z|[+-]\d{2}:?\d{2})\z"), ".expires_at: no time zone"))
    checks.append((blank("provenance"), ".provenance: empty"))
    sets = F.to_json(F.array(*(F.sort_array(F.coalesce(F.try_element_at("scope", F.lit(n)), F.array().cast("array<string>"))) for n in fields)))
    target = F.sha2(F.concat_ws("\0", F.upper(F.trim("entity_type")), F.lower(F.trim("value_sha256")), sets), 256)
    judged = assertions.select("position", F.trim("id").alias("id"), target.alias("target"), _first(checks, where).alias("own"))
    for n in ("id", "target"):
        judged = judged.join(judged.groupBy(n).agg(F.min("position").alias(f"first_{n}")), n, "left")
    again = F.when(F.col("first_id") < F.col("position"), F.concat(where, F.lit(".id: taken")))
    again = again.when(F.col("first_target") < F.col("position"), F.concat(where, F.lit(".scope: value taken in it")))
    return judged.select("position", F.coalesce("own", again).alias("error")).where("error is not null")


def _list_checks(values: Column, name: str) -> list[tuple[Column, str]]:
    """Faults of a list that may be left out: empty, with an empty or null member, or with one twice."""
    trimmed = F.transform(values, F.trim)
    return [
        (F.size(values) == 0, f"{name}: no members"),
        (F.exists(trimmed, lambda x: F.coalesce(x == "", F.lit(True))), f"{name}: an empty member"),
        (F.size(F.array_distinct(trimmed)) < F.size(values), f"{name}: one member twice"),
    ]


def _first(checks: list[tuple[Column, str]], where: Column) -> Column:
    out = F.lit(None).cast("string")
    for test, said in reversed(checks):
        out = F.when(test, said).otherwise(out)
    return F.concat(where, out)


def load(spark: SparkSession, rows: DataFrame) -> Policy:
    """A policy from a table of rules: id, priority, action, conditions map<string, array<string>>; over ``MOST_RULES`` of them are an error."""
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return Policy(tuple(Rule(r["id"], r["priority"], r["action"], {k: tuple(v) for k, v in (r["conditions"] or {}).items()}) for r in found))
