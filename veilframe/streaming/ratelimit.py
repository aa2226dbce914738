"""The rate limiter on a stream: one (start, count) of state an identity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ratelimit import SECOND, admit


def limited(requests: DataFrame, most: int = 60, window: int = 60) -> DataFrame:
    """identity, request_id, retry_after of a stream with request_id, identity and us (microseconds).

    State lapses once no request came for a window of processing time. Within a micro-batch
    requests are taken by time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        waits = []
        for us in rows["us"]:
            now, wait = admit(now, int(us), most, window)
            waits.append(wait)
        state.update(now)
        state.setTimeoutDuration(window * SECOND // 1000)
        yield pd.DataFrame({"identity": key[0], "request_id": rows["request_id"], "retry_after": pd.array(waits, "Int64")})

    out, kept = "identity string, request_id long, retry_after long", "start long, count long"
    return requests.groupBy("identity").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)
