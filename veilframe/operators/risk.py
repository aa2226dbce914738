"""Risk of a set of detections: a score of 0 to 100, a bucket and signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.patterns import RISK_WEIGHTS


def bucket(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def base(data_class: Column) -> Column:
    out = F.lit(0)
    for name, value in RISK_WEIGHTS.items():
        out = F.when(data_class == name, value).otherwise(out)
    return out


def single(d: Column) -> Column:
    """Points of one detection: weight times confidence, half to even, and its state's bonus."""
    points = F.bround(base(d["data_class"]) * F.greatest(F.lit(0.25), d["confidence"])).cast("int")
    return F.when(d["state"] == "VALID", points + 5).when(d["state"] == "AMBIGUOUS", points + 5).when(d["state"] == "INVALID", F.least(points, F.lit(15))).otherwise(points)


def assess(detections: Column) -> Column:
    """struct<score, bucket, signals> of an array of detections; none: 0, LOW."""
    live = F.filter(detections, lambda d: d["state"] != "INVALID")
    has = lambda name: F.exists(live, lambda d: d["data_class"] == name)
    quasi = F.size(F.array_distinct(F.transform(F.filter(live, lambda d: d["data_class"] == "QUASI_IDENTIFIER"), lambda d: d["entity_type"])))
    n = F.size(detections)
    combos = [
        (quasi >= 3, F.lit(25), F.concat(F.lit("combination:quasi_identifiers:"), quasi.cast("string"))),
        (quasi == 2, F.lit(12), F.lit("combination:quasi_identifiers:2")),
        (has("DIRECT_PII") & has("QUASI_IDENTIFIER"), F.lit(12), F.lit("combination:direct_pii_plus_quasi")),
        (has("LOCATION") & has("QUASI_IDENTIFIER"), F.lit(10), F.lit("combination:location_plus_quasi")),
        (has("FINANCIAL") & has("DIRECT_PII"), F.lit(10), F.lit("combination:financial_plus_direct_pii")),
        (n > 1, F.least(F.lit(10), 2 * (n - 1)), F.lit("combination:multiple_detections")),
    ]
    total = F.array_max(F.transform(detections, single)) + sum((F.when(c, p).otherwise(0) for c, p, _ in combos), F.lit(0))
    score = F.when(n > 0, F.least(F.lit(100), total)).otherwise(0)  # least() skips nulls
    states = F.filter(F.transform(detections, lambda d: F.concat(F.lit("validation:"), F.lower(d["state"]))), lambda x: x != "validation:valid")
    parts = [F.transform(detections, lambda d: F.concat(F.lit("class:"), d["data_class"])), states, F.array_compact(F.array(*[F.when(c, s) for c, _, s in combos]))]
    signals = F.when(n == 0, F.array(F.lit("no_sensitive_signals"))).otherwise(F.array_sort(F.array_distinct(F.concat(*parts))))
    return F.struct(score.alias("score"), bucket(score).alias("bucket"), signals.alias("signals"))
