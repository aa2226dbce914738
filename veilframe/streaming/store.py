"""Conversations and mappings kept between requests, as state by key.

Time is that of the requests. What has expired is gone for the next request at once; with a
watermark, timers remove it also where no request comes. No bound over all keys is kept, as it would need
state that all tasks share: a bound on keys is the number of partitions times what one holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The usual limits.
CONVERSATION_SECONDS, MAPPING_SECONDS = 1800, 3600
MESSAGES, CHARS = 40, 120_000
# Fixed values end.

Step = Callable[[dict | None, dict], tuple[dict | None, tuple]]


def kept(requests: DataFrame, keys: list[str], columns: list[str], step: Step, result: str, watermark: str | None) -> DataFrame:
    """``keys`` and ``result`` of what ``step`` makes of each request (seq, ts, ``columns``) and its key's state.

    State is a dictionary with ``expires`` in microseconds; None is no state. ``step`` sees no
    state that has expired. Within a micro-batch requests are taken by time, then ``seq``.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    rows = timed.select(*keys, "seq", "ts", F.unix_micros("ts").alias("us"), *columns)
    names = [c.strip().split()[0] for c in result.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        data, out = json.loads(state.get[0]) if state.exists else None, []
        for row in pd.concat(list(batches)).sort_values(["us", "seq"]).to_dict("records"):
            if data is not None and data["expires"] <= row["us"]:
                data = None
            data, made = step(data, row)
            out.append((*key, *made))
        if data is not None:
            state.update((json.dumps(data),))
            if watermark:
                state.setTimeoutTimestamp(max(data["expires"] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*keys, *names], dtype=object)

    schema = ", ".join([*(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys), result])
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "data string", "append", timeout)


def trimmed(messages: list[dict], most: int, chars: int) -> list[dict]:
    """The history that is kept: of too many messages two of the system and the last others, then the oldest go until they fit."""
    if len(messages) > most:
        system = [m for m in messages if m["role"] == "system"]
        messages = system[:2] + [m for m in messages if m["role"] != "system"][-max(most - 2, 2) :]
    size, gone = sum(len(m["text"] or "") for m in messages), set()
    oldest = [i for i, m in enumerate(messages) if m["role"] != "system"] + [i for i, m in enumerate(messages) if m["role"] == "system"]
    for i in oldest[: len(messages) - 1]:
        if size <= chars:
            break
        size -= len(messages[i]["text"] or "")
        gone.add(i)
    return [m for i, m in enumerate(messages) if i not in gone]


def conversations(requests: DataFrame, ttl_seconds: int = CONVERSATION_SECONDS, most_messages: int = MESSAGES, most_chars: int = CHARS, watermark: str | None = None) -> DataFrame:
    """owner, conv_id, seq, begins, history, after for requests (owner, conv_id, seq, ts, outcome, messages).

    A conversation is an owner's. Each request finds the ``history`` (array of role, text) and
    keeps the conversation alive for ``ttl_seconds``. Only the outcome ``ok`` adds the request's
    messages, trimmed; ``delete`` ends the conversation, any other (blocked, failed) leaves the
    history as it was. ``begins``: the request found no conversation, as none was or it had
    expired; ``after`` is how many messages are kept.
    """
    ttl, most, chars = max(ttl_seconds, 1) * 1_000_000, max(most_messages, 4), max(most_chars, 1000)
    counted = requests.withColumn("messages", F.to_json(F.coalesce("messages", F.array().cast("array<struct<role:string,text:string>>")), {"ignoreNullFields": "false"}))

    def step(data: dict | None, row: dict) -> tuple[dict | None, tuple]:
        history = data["messages"] if data else []
        after = history
        if row["outcome"] == "ok":
            after = trimmed(history + json.loads(row["messages"]), most, chars)
        shown = (row["seq"], data is None, json.dumps(history), 0 if row["outcome"] == "delete" else len(after))
        if row["outcome"] == "delete":
            return None, shown
        return {"messages": after, "expires": int(row["us"]) + ttl}, shown

    made = kept(counted, ["owner", "conv_id"], ["outcome", "messages"], step, "seq long, begins boolean, history string, after long", watermark)
    return made.withColumn("history", F.from_json("history", "array<struct<role:string,text:string>>"))


def mappings(requests: DataFrame, ttl_seconds: int = MAPPING_SECONDS, watermark: str | None = None) -> DataFrame:
    """request_id, seq, pairs for requests (request_id, seq, ts, action, items): what the mapping holds after the action.

    ``put`` keeps the items (array of replacement, original, restore) that may be restored, for
    ``ttl_seconds`` from then; looking (``get``) makes it live no longer; ``delete`` ends it.
    """
    ttl = ttl_seconds * 1_000_000
    may = F.filter("items", lambda x: x["restore"])
    pairs = F.to_json(F.transform(may, lambda x: F.struct(x["replacement"].alias("replacement"), x["original"].alias("original"))))

    def step(data: dict | None, row: dict) -> tuple[dict | None, tuple]:
        if row["action"] == "put":
            data = {"pairs": row["items"] or "[]", "expires": int(row["us"]) + ttl}
        elif row["action"] == "delete":
            data = None
        return data, (row["seq"], data["pairs"] if data else None)

    made = kept(requests.withColumn("items", pairs), ["request_id"], ["action", "items"], step, "seq long, pairs string", watermark)
    return made.withColumn("pairs", F.from_json("pairs", "array<struct<replacement:string,original:string>>"))
