"""Detection quality over a corpus of cases with expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.intermediate import cut
from . import detect, metrics

CASE = "id string, locale string, text string, entities array<struct<type string, value string, occurrence int>>"


def load(spark: SparkSession, root: str) -> DataFrame:
    """Cases of the ``*.jsonl`` files in a folder: case_id, locale, text, entities, from (file name).

    Blank lines are skipped; a line that is no case, or an id that two cases share, is an error.
    """
    lines = spark.read.text(f"{root}/*.jsonl").where(F.trim("value") != "").select(F.from_json("value", CASE).alias("c"), F.col("_metadata.file_name").alias("from"))
    cases = lines.select(F.col("c.id").alias("case_id"), "c.locale", "c.text", "c.entities", "from")
    wrong = cases.groupBy("case_id").agg(F.count("*").alias("n"), F.min("from").alias("from")).where("n > 1 or case_id is null").limit(1).collect()
    if wrong:
        raise ValueError(f"a case without an id, or an id used twice: {wrong[0]['case_id']!r} in {wrong[0]['from']}")
    return cases


def place(text: Column, value: Column, occurrence: Column) -> Column:
    """Start of the ``occurrence``-th (from 0) of a value's occurrences that do not overlap; null where there is none."""
    turns = F.sequence(F.lit(0), F.coalesce(occurrence, F.lit(0)))

    def step(at: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(1)).otherwise(at + F.length(value))
        return F.when(at.isNull(), at).otherwise(F.nullif(F.call_function("locate", value, text, begin), F.lit(0)))

    return F.aggregate(turns, F.lit(1), step) - 1


def expected(cases: DataFrame) -> DataFrame:
    """case_id, entity_type, start, end of the expected values; a value that its text does not hold is an error."""
    each = cases.select("case_id", "text", F.explode("entities").alias("e"))
    start = place(F.col("text"), F.col("e.value"), F.col("e.occurrence"))
    found = each.select("case_id", F.col("e.type").alias("entity_type"), start.alias("start"), F.length("e.value").alias("n"))
    missing = F.raise_error(F.concat(F.lit("expected value not found in case "), F.col("case_id").cast("string"))).cast("int")
    return found.select("case_id", "entity_type", F.coalesce("start", missing).alias("start"), (F.col("start") + F.col("n")).alias("end"))


def evaluate(cases: DataFrame, profile: str = "BALANCED") -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1 of the detectors on ``cases``, in order of type."""
    seen = cut(detect.detect(cut(cases.select("case_id", "text")), profile=profile).drop("text"))
    predicted = seen.select("case_id", F.explode("detections").alias("d")).select("case_id", "d.entity_type", "d.start", "d.end")
    return metrics.quality(expected(cases), predicted).orderBy("entity_type")


def report(result: DataFrame, profile: str, cases: DataFrame, version: str) -> DataFrame:
    """One row ``report``: the result as JSON with sorted keys (a dozen types at most reach it)."""
    each = F.struct("entity_type", F.struct(*sorted(c for c in result.columns if c != "entity_type")).alias("value"))
    by_type = result.agg(F.map_from_entries(F.sort_array(F.collect_list(each))).alias("per_entity"))
    counted = by_type.crossJoin(cases.agg(F.count("*").alias("case_count")))
    return counted.select(F.to_json(F.struct("case_count", F.lit(version).alias("corpus_version"), "per_entity", F.lit(profile.lower()).alias("profile"))).alias("report"))
