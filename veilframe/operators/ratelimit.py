"""A fixed-window rate limiter whose window starts at an identity's first request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000


def admit(state: tuple[int, int] | None, now: int, most: int, window: int) -> tuple[tuple[int, int], int | None]:
    """The next (start, count), and the seconds to wait (None: admitted); times in microseconds."""
    if state is None or state[0] + window * SECOND <= now:
        return (now, 1), None
    if state[1] < most:
        return (state[0], state[1] + 1), None
    return state, max(-((now - state[0] - window * SECOND) // SECOND), 1)


def limited(requests: DataFrame, most: int = 60, window: int = 60) -> DataFrame:
    """request_id, retry_after (null: admitted) of requests with request_id, identity and ts.

    Requests of an identity are taken by ts, then request_id; a null identity is one of its own.
    Rows are sorted within partitions and read once, so a task keeps one window, however
    many requests an identity has. There is no bound on identities, as state is not shared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, state = None, None
        for batch in batches:
            waits = []
            for identity, now in zip(batch["identity"], batch["us"], strict=True):
                if identity != who:
                    who, state = identity, None
                state, wait = admit(state, now, most, window)
                waits.append(wait)
            yield pd.DataFrame({"request_id": batch["request_id"], "retry_after": pd.array(waits, "Int64")})

    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    named = F.coalesce(F.concat(F.lit("="), F.col("identity").cast("string")), F.lit(""))
    made = requests.where("ts is not null").select(F.col("request_id").cast("long").alias("request_id"), named.alias("identity"), us.alias("us"))
    return made.repartition("identity").sortWithinPartitions("identity", "us", "request_id").mapInPandas(run, "request_id long, retry_after long")
