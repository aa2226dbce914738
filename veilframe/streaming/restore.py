"""Restoring tokens in a stream of fragments: a token cut by two fragments is held, never shown in parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def restored(text: str, pairs: list[tuple[str, str]]) -> str:
    for replacement, original in sorted(pairs, key=lambda p: -len(p[0])):
        text = text.replace(replacement, original)
    return text


def push(held: str, text: str, pairs: list[tuple[str, str]]) -> tuple[str, str]:
    """(what may be shown, what is held) once ``text`` follows what was held.

    Held is what follows the last ``<``, if some replacement begins with it and goes on.
    """
    whole = held + text
    at = whole.rfind("<")
    tail = whole[at:] if at >= 0 else ""
    hold = bool(tail) and any(r.startswith(tail) and r != tail for r, _ in pairs)
    return restored(whole[:at] if hold else whole, pairs), tail if hold else ""


def restore(fragments: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """stream_id, seq, text of a stream with stream_id, seq, fragment, done and pairs (replacement, original).

    State is the held tail alone, shorter than a token. ``done`` marks a stream's last fragment,
    which shows all that is held; a stream that stays idle for ``idle_ms`` drops its tail, as a
    part of a token must not be shown. With None no tail is dropped, as for an input that ends: a
    query with a timeout goes on after its input. Within a micro-batch fragments are taken by ``seq``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        shown = []
        for fragment, done, pairs in zip(rows["fragment"], rows["done"], rows["pairs"]):
            known = [(p["replacement"], p["original"]) for p in (pairs if pairs is not None else [])]
            out, held = push(held, fragment or "", known)
            if done:
                out, held = out + restored(held, known), ""
            shown.append(out)
        if held:
            state.update((held,))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream_id": key[0], "seq": rows["seq"], "text": shown})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return fragments.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string", "held string", "append", timeout)
