"""The guard of answers on a stream of chunks: nothing is shown before its field is complete.

Chunks are taken apart by expressions, the state holds each field's text so far, and what comes
out whole meets the same guard as an answer that came in one piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.wire import guard_text

# What ends a stream, and the most characters of an answer.
DONE = "[DONE]"
MOST_CHARS = 8 * 1024 * 1024
# Fixed values end.

_PART = "struct<at:int,choice:int,field:string,fragment:string,ends:boolean>"


def parts(events: DataFrame) -> DataFrame:
    """``events`` (stream_id, seq, chunk, ...) with ``part``: a row for each text of a chunk, and one for each end.

    A choice ends with a ``finish_reason``, a stream with ``[DONE]`` (then choice is null).
    Chunks that are no JSON or hold no choices give nothing.
    """
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    end = F.struct(F.lit(1 << 30).alias("at"), F.lit(None).cast("int").alias("choice"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("fragment"), F.lit(True).alias("ends"))

    def of_choice(c: Column, i: Column) -> Column:
        one = lambda at, name, v: F.struct((i * 1000 + at).cast("int").alias("at"), i.cast("int").alias("choice"), name.alias("field"), v.alias("fragment"), F.lit(False).alias("ends"))
        got = lambda path: text(F.try_variant_get(c, path, "variant"))
        plain = [one(k, F.lit(name), got(path)) for k, (name, path) in enumerate((("content", "$.delta.content"), ("refusal", "$.delta.refusal"), ("function_call", "$.delta.function_call.arguments")))]
        calls = F.coalesce(F.try_variant_get(c, "$.delta.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
        tools = F.transform(calls, lambda t, k: one(k + 3, F.concat(F.lit("tool_calls["), k, F.lit("]")), text(F.try_variant_get(t, "$.function.arguments", "variant"))))
        said = F.filter(F.concat(F.array(*plain), tools), lambda p: p["fragment"] != "")
        over = F.struct((i * 1000 + 999).cast("int").alias("at"), i.cast("int").alias("choice"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("fragment"), F.lit(True).alias("ends"))
        return F.concat(said, F.when(got("$.finish_reason").isNotNull(), F.array(over)).otherwise(F.array().cast(f"array<{_PART}>")))

    choices = F.coalesce(F.try_variant_get(F.try_parse_json("chunk"), "$.choices", "array<variant>"), F.array().cast("array<variant>"))
    found = F.when(F.trim("chunk") == DONE, F.array(end)).otherwise(F.flatten(F.transform(choices, of_choice)))
    return events.withColumn("part", F.explode(found))


def push(held: list[list], choice: int | None, field: str | None, fragment: str | None, ends: bool) -> list[list]:
    """Adds to ``held`` ([choice, field, text], in order of first appearance); gives what is complete, and lets it go."""
    if not ends:
        for row in held:
            if row[:2] == [choice, field]:
                row[2] += fragment
                return []
        held.append([choice, field, fragment])
        return []
    done = [row for row in held if choice is None or row[0] == choice]
    held[:] = [row for row in held if row not in done]
    return done


def buffered(events: DataFrame, idle_ms: int | None = 600_000, most_chars: int = MOST_CHARS) -> DataFrame:
    """stream_id, choice, field, text, pairs, error of a stream of chunks (stream_id, seq, chunk, pairs).

    A field comes out whole when its choice or its stream ends. A stream that holds more than
    ``most_chars`` comes out as one row with ``too_large`` and no text, and so does not what
    follows; one that is idle for ``idle_ms`` is dropped unseen (None: never, for an input that
    ends). Within a micro-batch chunks are taken by ``seq``. ``pairs`` are those of the stream's
    last chunk that has any.
    """
    flat = parts(events).select("stream_id", "seq", "part.*", F.to_json("pairs").alias("pairs"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        data = json.loads(state.get[0]) if state.exists else {"held": [], "pairs": None, "over": False}
        rows, out = pd.concat(list(batches)).sort_values(["seq", "at"]), []
        for choice, field, fragment, ends, pairs in zip(rows["choice"], rows["field"], rows["fragment"], rows["ends"], rows["pairs"], strict=True):
            data["pairs"] = pairs or data["pairs"]
            if data["over"]:
                data["over"] = not (ends and pd.isna(choice))
                continue
            done = push(data["held"], None if pd.isna(choice) else int(choice), field, fragment, bool(ends))
            out += [(key[0], c, f, t, data["pairs"], None) for c, f, t in done]
            if sum(len(t) for _, _, t in data["held"]) > most_chars:
                data["over"], data["held"] = True, []
                out.append((key[0], None, None, None, None, "too_large"))
        if data["held"] or data["over"]:
            state.update((json.dumps(data),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        made = pd.DataFrame(out, columns=["stream_id", "choice", "field", "text", "pairs", "error"], dtype=object)
        yield made.astype({"choice": "Int32"})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    made = flat.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, choice int, field string, text string, pairs string, error string", "data string", "append", timeout)
    return made.withColumn("pairs", F.from_json("pairs", "array<struct<replacement:string,original:string>>"))


def guarded(events: DataFrame, idle_ms: int | None = 600_000, most_chars: int = MOST_CHARS) -> DataFrame:
    """stream_id, choice, field, guarded, error: every field of a stream as :func:`wire.guard_text` gives it whole."""
    return guard_text(buffered(events, idle_ms, most_chars)).select("stream_id", "choice", "field", "guarded", "error")
