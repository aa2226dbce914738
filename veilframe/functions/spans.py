"""Spans of a pattern in a text, by code points, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.patterns import LOOKS


def looked(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` plus a boolean ``prefix`` + name for each of ``LOOKS``: whether ``text`` has it.

    Columns of their own, each read by several patterns, so that a text is looked at once for all.
    """
    for name, (pattern, first) in LOOKS.items():
        has = F.col(text).rlike("(?U)" + pattern)
        df = df.withColumn(prefix + name, F.coalesce(F.col(prefix + first) & has if first else has, F.lit(False)))
    return df


def spans(text: Column, pattern: str, group: int = 0, cue: str = "", gate: str = "", maybe: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's leftmost matches.

    ``group`` is 0 or a group at the end of the match. ``maybe``, a column, ``cue``, a literal, and
    ``gate``, a pattern that is cheap to look for, spare texts that cannot match. Places come from
    one running sum.
    """
    rule = F.lit("(?U)" + pattern)
    pieces = F.split(text, "(?U)" + pattern, -1)
    parts = [pieces.alias("p"), F.regexp_extract_all(text, rule, F.lit(0)).alias("m")]
    if group:
        parts.append(F.regexp_extract_all(text, rule, F.lit(group)).alias("v"))
    nothing = F.array().cast(SPANS)

    def step(a: Column, x: Column) -> Column:
        value = x["v"] if group else x["m"]
        at = a["at"] + F.length(x["p"]) + F.length(x["m"])
        found = F.struct((at - F.length(value)).alias("start"), at.alias("end"), value.alias("value"))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(at.alias("at"), F.concat(a["out"], F.array(found)).alias("out")))

    made = F.aggregate(F.arrays_zip(*parts), F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda a: a["out"])
    maybe = text.isNotNull() if maybe is None else maybe & text.isNotNull()
    if cue:
        maybe = maybe & text.contains(cue)
    if gate:
        maybe = maybe & text.rlike("(?U)" + gate)
    return F.when(maybe, made).otherwise(nothing)


SPANS = "array<struct<start:int,end:int,value:string>>"


def splice(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, replacement; in order, apart) replaced."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["replacement"]).alias("out"), s["end"].alias("at")
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
