import datetime
import json

from pyspark.sql import functions as F

from veilframe.operators import adapters, wire
from veilframe.streaming import guard, store

TOKEN, OTHER = "<MG:" + "A" * 26 + ">", "<MG:" + "B" * 26 + ">"
PAIRS = [(TOKEN, "ann@example.com")]
EVENT = "stream_id string, seq long, chunk string, pairs array<struct<replacement:string,original:string>>"


def chunk(choice=0, finish=None, **delta):
    blank = [{"index": k, "delta": {}} for k in range(choice)]
    return json.dumps({"choices": [*blank, {"index": choice, "delta": delta, "finish_reason": finish}]})


def run(spark, tmp_path, batches, schema, query):
    """Rows of a streaming query over files, one a micro-batch."""
    import os
    import time

    for k, rows in enumerate(batches):
        path = tmp_path / f"in{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        os.makedirs(tmp_path / "all", exist_ok=True)
        (part,) = path.glob("*.parquet")
        part.rename(tmp_path / "all" / f"{k}.parquet")
        os.utime(tmp_path / "all" / f"{k}.parquet", (time.time() - 100 + k,) * 2)
    name = "t_" + tmp_path.name.replace("-", "_")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    running = query(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert running.awaitTermination(200)
    return spark.table(name).collect()


def test_every_split_gives_the_whole():
    text = f"to {TOKEN} from eve@example.com"
    for at in range(len(text) + 1):
        held = []
        for part in (text[:at], text[at:]):
            assert guard.push(held, 0, "content", part, False) == []
        assert guard.push(held, 1, None, None, True) == []
        assert guard.push(held, 0, None, None, True) == [[0, "content", text]] and held == []


def test_streamed_guard_equals_the_guard_of_whole_texts(spark, tmp_path):
    said = f"to {TOKEN}, not {OTHER}, cc eve@example.com"
    events = []
    for k, at in enumerate(range(0, len(said), 7)):
        part = said[at : at + 7]
        events.append((f"a{at % 2}", k, chunk(content=part), PAIRS))
        events.append(("b", k, chunk(1, content=part, function_call={"arguments": part}, tool_calls=[{"function": {}}, {"function": {"arguments": part}}]), PAIRS))
        events.append(("cut", k, chunk(content=part), None))
        events.append(("big", k, chunk(refusal="x" * 90), None))
    events += [("a0", 90, chunk(finish="stop"), None), ("a1", 90, "[DONE]", None), ("b", 90, chunk(1, finish="tool_calls"), None), ("a0", 91, "no json", None), ("a0", 92, chunk(content=""), None)]
    batches = [events[k : k + 6] for k in range(0, len(events), 6)]
    got = run(spark, tmp_path, batches, EVENT, lambda df: guard.guarded(df, None, most_chars=400))
    shown = {(r["stream_id"], r["choice"], r["field"]): r["guarded"] for r in got if r["error"] is None}
    assert [(r["stream_id"], r["guarded"], r["error"]) for r in got if r["error"]] == [("big", None, "too_large")]
    whole = adapters.buffered(spark.createDataFrame([e for e in events if e[0] not in ("cut", "big")], EVENT)).withColumn("pairs", F.array(F.struct(F.lit(TOKEN).alias("replacement"), F.lit("ann@example.com").alias("original"))))
    want = {(r["stream_id"], r["choice"], r["field"]): r["guarded"] for r in wire.guard_text(whole).collect()}
    assert shown == want and len(want) == 5
    assert shown["b", 1, "tool_calls[1]"] == "to ann@example.com, not [REDACTED_PROVIDER_TOKEN], cc [REDACTED_PROVIDER_EMAIL]"


TURN = "owner string, conv_id string, seq long, ts timestamp, outcome string, messages array<struct<role:string,text:string>>"


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_conversations_keep_what_succeeded(spark, tmp_path):
    u, a, s = (lambda t, r=r: (r, t) for r in ("user", "assistant", "system"))
    batches = [
        [("x", "c", 1, at(0), "ok", [s("S"), u("one"), a(None)]), ("y", "c", 1, at(0), "ok", [u("own")])],
        [("x", "c", 2, at(50), "blocked", [u("bad")]), ("x", "c", 3, at(60), "ok", [u("two"), a("B" * 990)])],
        [("x", "c", 4, at(150), "touch", None), ("y", "c", 2, at(150), "ok", [u("new")]), ("x", "c", 5, at(260), "ok", [u("late")])],
        [("x", "c", 6, at(270), "delete", None), ("x", "c", 7, at(271), "ok", [u("again")])],
    ]
    got = run(spark, tmp_path, batches, TURN, lambda df: store.conversations(df, 100, most_chars=995))
    shown = {(r["owner"], r["seq"]): (r["begins"], [m["text"] for m in r["history"]], r["after"]) for r in got}
    assert shown == {
        ("x", 1): (True, [], 3), ("x", 2): (False, ["S", "one", None], 3), ("x", 3): (False, ["S", "one", None], 5), ("x", 4): (False, ["S", "one", None, "two", "B" * 990], 5),
        ("x", 5): (True, [], 1), ("x", 6): (False, ["late"], 0), ("x", 7): (True, [], 1), ("y", 1): (True, [], 1), ("y", 2): (True, [], 1),
    }


def test_timers_remove_what_is_idle(spark, tmp_path):
    """A conversation that no request asks for goes once the watermark has passed its end, not before."""
    turn = lambda o, n, t: (o, "c", n, at(t), "ok", [("user", str(n))])
    batches = [[turn("x", 1, 0)], [turn("y", 1, 90)], [turn("x", 2, 95)], [turn("y", 2, 5000)], [turn("z", 1, 5001)], [turn("z", 2, 5002)]]
    got = run(spark, tmp_path, batches, TURN, lambda df: store.conversations(df, 100, watermark="10 seconds"))
    assert {(r["owner"], r["seq"]): r["begins"] for r in got} == {("x", 1): True, ("y", 1): True, ("x", 2): False, ("y", 2): True, ("z", 1): True, ("z", 2): False}


def test_trimming():
    m = lambda *roles: [{"role": r, "text": f"{k}"} for k, r in enumerate(roles)]
    show = lambda x: [i["text"] for i in x]
    assert show(store.trimmed(m("system", "user", "system", "user", "system", "user"), 5, 99)) == ["0", "2", "1", "3", "5"]
    assert show(store.trimmed(m("system", "user", "user", "user"), 9, 2)) == ["0", "3"]
    assert show(store.trimmed(m("system", "system"), 9, 0)) == ["1"]


def test_mappings(spark, tmp_path):
    kind = "request_id string, seq long, ts timestamp, action string, items array<struct<replacement:string,original:string,restore:boolean>>"
    items = [("<t>", "ann", True), ("[R]", "bob", False)]
    batches = [[("r", 1, at(0), "get", None), ("r", 2, at(1), "put", items)], [("r", 3, at(90), "get", None), ("q", 1, at(90), "put", None)], [("r", 4, at(101), "get", None), ("q", 2, at(91), "delete", None)]]
    got = run(spark, tmp_path, batches, kind, lambda df: store.mappings(df, 100))
    shown = {(r["request_id"], r["seq"]): None if r["pairs"] is None else [tuple(p) for p in r["pairs"]] for r in got}
    assert shown == {("r", 1): None, ("r", 2): [("<t>", "ann")], ("r", 3): [("<t>", "ann")], ("r", 4): None, ("q", 1): [], ("q", 2): None}
