"""The composite transform: detect, assess, decide for each finding, and mask, or refuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.intermediate import cut
from . import policy, risk
from .detect import detect
from .mask import injected, opaque_token, replaced, semantic_token, spliced, surrogate

#: Actions that let no text pass (two of them have no safe form).
REFUSING = ("BLOCK", "REQUIRE_REVIEW", "GENERALIZE", "HASH")
REPLACING = ("TOKENIZE", "SURROGATE", "REDACT")
# Fixed values end.


def transform(
    df: DataFrame, rules: policy.Policy, assertions: DataFrame | None = None, order: str | None = None, opaque: bool = True, key: str = "", profile: str = "BALANCED"
) -> tuple[DataFrame, DataFrame]:
    """(rows with masked, error, blocked; vault) of ``df`` with scope_id, text and context columns.

    Every finding is decided by ``rules`` over the context columns, entity_type, data_class,
    confidence, recognizer, risk_bucket and risk_score; ``assertions`` may make it public. In a
    scope a value keeps the replacement of its first finding (by ``order``, then place), whatever
    is decided later. A text with a refused finding, or with reserved tokens, is not returned:
    ``masked`` is null, ``error`` is ``blocked`` or ``reserved_token``, and ``blocked`` lists the
    refused types. A null text stays null without error.
    """
    names = [c for c in df.columns if c not in ("text", "scope_id")]
    seen = detect(df, profile=profile).withColumn("risk", risk.assess(F.col("detections")))
    rows = cut(seen.withColumn("_row", F.monotonically_increasing_id()))
    at = F.struct(F.col(order) if order else F.lit(0), F.col("_row"), F.col("d.start"))
    found = rows.select("_row", "scope_id", *names, F.col("risk.bucket").alias("risk_bucket"), F.col("risk.score").alias("risk_score"), F.explode("detections").alias("d"))
    found = found.select("*", at.alias("pos"), *(F.col(f"d.{c}").alias(c) for c in ("entity_type", "data_class", "confidence", "recognizer", "value", "start", "end"))).drop("d")
    public = None
    if assertions is not None:
        found, public = policy.asserted(found, assertions), F.col("public")
    found = cut(policy.decide(found, rules, public).select("_row", "scope_id", "entity_type", "value", "start", "end", "pos", "action"))
    changed = found.where(F.col("action").isin(*REPLACING))
    table = cut(_vault(changed, opaque, key))
    refused = found.where(F.col("action").isin(*REFUSING)).groupBy("_row").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("start", "entity_type"))), lambda x: x["entity_type"])).alias("blocked"))
    out = spliced(rows, replaced(changed, table), "text").join(refused, "_row", "left")
    error = F.when(injected(F.col("text")), "reserved_token").when(F.size("blocked") > 0, "blocked")
    out = out.withColumn("error", error).withColumn("masked", F.when(F.col("error").isNull(), F.col("masked")))
    return out.drop("_row", "detections", "risk"), table


def _vault(changed: DataFrame, opaque: bool, key: str) -> DataFrame:
    """scope_id, entity_type, original, replacement, restore, by the first finding of each value in a scope."""
    first = changed.groupBy("scope_id", F.col("value").alias("original")).agg(F.min_by(F.struct("entity_type", "action"), "pos").alias("f"), F.min("pos").alias("pos"))
    first = first.select("scope_id", "original", "pos", "f.*")
    n = F.row_number().over(Window.partitionBy("scope_id", "action", "entity_type").orderBy("pos", "original"))
    token = opaque_token(F.coalesce(F.col("scope_id").cast("string"), F.lit("")), F.col("original"), key) if opaque else semantic_token("r", F.col("entity_type"), F.col("n"))
    made = (
        F.when(F.col("action") == "REDACT", F.concat(F.lit("[REDACTED_"), "entity_type", F.lit("]")))
        .when(F.col("action") == "SURROGATE", surrogate(F.col("entity_type"), F.col("n")))
        .otherwise(token)
    )
    return first.withColumn("n", n).select("scope_id", "entity_type", "original", made.alias("replacement"), (F.col("action") != "REDACT").alias("restore"))
