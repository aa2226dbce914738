"""Detection: recognizers, thresholds, merging of equal spans and greedy de-overlap.

All of it is expressions over one array of candidates per text, so a text is scanned where it
lies and nothing is shuffled. Patterns see the canonical text; spans are those of the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, validators
from ..functions.spans import looked, spans
from ..plans import patterns as P

DETECTION = "struct<ord:int,entity_type:string,data_class:string,start:int,end:int,confidence:double,recognizer:string,state:string,value:string>"


def candidates(text: Column, profile: str = "BALANCED", looks: str = "") -> Column:
    """Candidates of all recognizers that reach the profile's threshold, in recognizer order.

    ``looks`` is the prefix of the columns of :func:`looked`, if there are any.
    """
    specs = [*P.SECRETS, *P.STRUCTURED, *([P.BARE_PASSPORT] if profile == "STRICT" else []), *P.NETWORK, *P.LEGACY]
    found = [_candidates(text, k, s, profile, looks) for k, s in enumerate(specs)]
    if P.BARE_PASSPORT in specs:  # not where a labelled passport covers it
        labelled, bare = (found[k] for k, s in enumerate(specs) if s.entity_type == "PASSPORT")
        inside = lambda c: F.exists(labelled, lambda p: (p["start"] <= c["start"]) & (c["end"] <= p["end"]))
        found[specs.index(P.BARE_PASSPORT)] = F.filter(bare, lambda c: ~inside(c))
    return F.filter(F.concat(*found), lambda c: c["confidence"] >= P.THRESHOLDS[profile])


def _candidates(text: Column, ordinal: int, spec: P.Spec, profile: str, looks: str) -> Column:
    def one(s: Column) -> Column:
        value, confidence, state = s["value"], F.lit(spec.confidence), F.lit(spec.state)
        if spec.recognizer == "legacy-regex":
            value = F.rtrim(value, F.lit(P.TRAILING))
        valid = {"INN": validators.inn, "SNILS": validators.snils, "IBAN": validators.iban, "CARD_NUMBER": validators.luhn}.get(spec.entity_type)
        if valid:
            weak = {"CARD_NUMBER": 0.52, "INN": 0.58}.get(spec.entity_type, 0.0) if spec.recognizer == "legacy-regex" else 0.0
            ok = valid(value)
            confidence = F.when(ok, confidence).otherwise(weak if profile == "STRICT" else 0.0)
            state = F.when(ok, state).otherwise("INVALID")
        end = s["start"] + F.length(value)
        return F.struct(
            F.lit(ordinal).alias("ord"), F.lit(spec.entity_type).alias("entity_type"), F.lit(spec.data_class).alias("data_class"), s["start"].alias("start"), end.alias("end"),
            confidence.cast("double").alias("confidence"), F.lit(spec.recognizer).alias("recognizer"), state.alias("state"), value.alias("value"),
        )

    maybe = F.col(looks + spec.look) if looks and spec.look else None
    out = F.transform(spans(text, spec.pattern, spec.group, spec.cue, spec.gate, maybe), one)
    if spec.entity_type == "CARD_NUMBER":  # dropped where it touches letters, digits, _ or -
        before = lambda c: F.substring(text, c["start"], F.when(c["start"] > 0, 1).otherwise(0))
        out = F.filter(out, lambda c: ~before(c).rlike(r"(?U)[\p{Alnum}_-]") & ~F.substring(text, c["end"] + 1, 1).rlike(r"(?U)[\p{Alnum}_-]"))
    return F.filter(out, lambda c: c["end"] > c["start"])


def merge_equal(found: Column) -> Column:
    """One candidate for each (type, start, end), in order of first appearance.

    The more confident one stays (ties: the earlier); each merge adds 0.02, up to 1, and joins
    the recognizers' names.
    """
    same = lambda a, b: (a["entity_type"] == b["entity_type"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])

    def join(a: Column, b: Column) -> Column:
        best = F.when(b["confidence"] > a["confidence"], b).otherwise(a)
        name = F.when(F.array_contains(F.split(a["recognizer"], r"\+"), b["recognizer"]), a["recognizer"]).otherwise(F.concat_ws("+", a["recognizer"], b["recognizer"]))
        fields = {"ord": a["ord"], "confidence": F.least(F.lit(1.0), F.round(best["confidence"] + 0.02, 10)), "recognizer": name}
        names = [x.split(":")[0] for x in DETECTION[7:-1].split(",")]
        return F.struct(*[fields.get(n, best[n]).alias(n) for n in names])

    def step(acc: Column, c: Column) -> Column:
        merged = F.transform(acc, lambda a: F.when(same(a, c), join(a, c)).otherwise(a))
        return F.when(F.exists(acc, lambda a: same(a, c)), merged).otherwise(F.concat(acc, F.array(c)))

    keys = F.transform(found, lambda c: F.concat_ws(":", c["entity_type"], c["start"], c["end"]))
    differ = F.size(F.array_distinct(keys)) == F.size(found)
    return F.when((F.size(found) < 2) | differ, found).otherwise(F.aggregate(found, F.array().cast(f"array<{DETECTION}>"), step))


def priority(entity_type: Column, values: dict[str, int] = P.PRIORITY) -> Column:
    out = F.lit(0)
    for name, value in values.items():
        out = F.when(entity_type == name, value).otherwise(out)
    return out


def resolve_overlaps(found: Column, priorities: dict[str, int] = P.PRIORITY) -> Column:
    """Greedy de-overlap by priority, confidence, length and start; the result in text order."""
    keyed = F.transform(
        found,
        lambda c, i: F.struct(
            (-priority(c["entity_type"], priorities)).alias("a"), (-c["confidence"]).alias("b"), (c["start"] - c["end"]).alias("c"), c["start"].alias("d"), i.alias("e"), c.alias("it")
        ),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["it"])
    kept = F.aggregate(
        ordered,
        F.array().cast(f"array<{DETECTION}>"),
        lambda acc, c: F.when(F.exists(acc, lambda a: (c["start"] < a["end"]) & (c["end"] > a["start"])), acc).otherwise(F.concat(acc, F.array(c))),
    )
    # Sorted by start, spans are apart if each ends before the next begins.
    apart = F.aggregate(_by_place(found), F.struct(F.lit(0).alias("end"), F.lit(True).alias("ok")), lambda a, c: F.struct(c["end"].alias("end"), (a["ok"] & (c["start"] >= a["end"])).alias("ok")), lambda a: a["ok"])
    return F.when(F.size(found) < 2, found).otherwise(_by_place(F.when(apart, found).otherwise(kept)))


def _by_place(found: Column) -> Column:
    placed = F.transform(found, lambda c: F.struct(c["start"].alias("a"), c["end"].alias("b"), c["entity_type"].alias("t"), c.alias("it")))
    return F.transform(F.array_sort(placed), lambda k: k["it"])


def _to_original(found: Column, view: Column, text: Column) -> Column:
    def back(d: Column) -> Column:
        start, end = canonical.original_span(view, d["start"], d["end"])
        own = {"start": start, "end": end, "value": F.substring(text, start + 1, end - start)}
        names = [x.split(":")[0] for x in DETECTION[7:-1].split(",")]
        return F.struct(*[own.get(n, d[n]).alias(n) for n in names])

    return F.when(view["text"].isNull(), found).otherwise(F.transform(found, back))


def detect(df: DataFrame, text: str = "text", profile: str = "BALANCED", into: str = "detections", plain: bool = False) -> DataFrame:
    """``df`` plus an array of detections of column ``text`` (null: none).

    ``plain`` takes texts as they are, without the canonical view.
    """
    if plain:
        looks = f"_{into}_"
        # Every pattern needs more than letters, or 20 of them.
        maybe = F.col(text).rlike("[^A-Za-z]") | (F.length(text) >= 20)
        some = F.when(maybe, candidates(F.col(text), profile, looks)).otherwise(F.array().cast(f"array<{DETECTION}>"))
        stages = looked(df, text, looks).withColumn(into, some).drop(*[looks + name for name in P.LOOKS])
        return stages.withColumn(into, merge_equal(F.col(into))).withColumn(into, resolve_overlaps(F.col(into)))
    seen = df.withColumn("_view", canonical.view(F.col(text))).withColumn("_seen", F.coalesce("_view.text", text))
    found = detect(seen, "_seen", profile, into, plain=True)
    return found.withColumn(into, _to_original(F.col(into), F.col("_view"), F.col(text))).drop("_view", "_seen")
