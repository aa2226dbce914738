"""Counters, latency summaries, nearest-rank percentiles, and detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = 256


def label(value: Column) -> Column:
    """Upper-case label of a closed grammar, else UNKNOWN."""
    up = F.upper(F.trim(value))
    return F.when(up.rlike(r"\A[A-Z][A-Z0-9_]{0,63}\z"), up).otherwise("UNKNOWN")


def counters(events: DataFrame, name: str, order: str, most: int = LABELS) -> DataFrame:
    """label, n; labels beyond the first ``most`` in order of first appearance become OTHER."""
    each = events.groupBy(label(F.col(name)).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    ranked = each.withColumn("rank", F.row_number().over(Window.orderBy("seen", "label")))  # one row a label
    return ranked.groupBy(F.when(F.col("rank") <= most, F.col("label")).otherwise("OTHER").alias("label")).agg(F.sum("n").alias("n"))


def latency(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """stage, count, total_ms and maximum_ms."""
    ms = F.col(seconds) * 1000
    return events.groupBy(F.col(stage).alias("stage")).agg(F.count(ms).alias("count"), F.sum(ms).alias("total_ms"), F.max(ms).alias("maximum_ms"))


def nearest_rank(events: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """group, n and the value at index round((n - 1) * share), half to even, of the sorted values.

    Equal values are counted before the window, so it runs over distinct values.
    """
    each = events.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("label"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("label").orderBy("v"))
    counted = each.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy("label"))})
    return counted.where(F.col("upto") > F.bround((F.col("n") - 1) * share)).groupBy("label", "n").agg(F.min("v").alias("value"))


def quality(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1 over (case_id, entity_type, start, end)."""
    keys = ["case_id", "entity_type", "start", "end"]
    e, p = (d.select(keys).distinct().withColumn(n, F.lit(1)) for d, n in ((expected, "e"), (predicted, "p")))
    both = e.join(p, keys, "full")
    out = both.groupBy("entity_type").agg(
        F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    ratio = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(other)))
    out = out.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


def principal(authorization: Column, client: Column | None = None) -> Column:
    """struct<tenant_id, subject_id, method> of an authorization header; the whole secret is only hashed.

    Without a header the caller is local and known by its host (null or empty: ``unknown``).
    """
    secret = F.when(authorization.rlike(r"(?is)\Abearer .+"), F.regexp_replace(authorization, r"(?s)\A.{7}", "")).otherwise(authorization)
    sha = F.sha2(secret, 256)
    host = F.lit(None).cast("string") if client is None else client
    local = F.sha2(F.coalesce(F.when(host != "", host), F.lit("unknown")), 256)
    given = F.coalesce(authorization != "", F.lit(False))
    part = lambda kind, value, at: F.concat(F.lit(f"{kind}:"), F.substring(value, at, 32))
    return F.struct(
        F.when(given, part("credential", sha, 1)).otherwise("local").alias("tenant_id"),
        F.when(given, part("credential", sha, 33)).otherwise(part("client", local, 1)).alias("subject_id"),
        F.when(given, "bearer").otherwise("local").alias("method"),
    )
