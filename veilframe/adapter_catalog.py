"""Registered queries over provider formats and stored conversations, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import adapters, conversations, gateway, mask, settings, turns
from .plans.intermediate import cut


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_to_gemini(spark, sf_dir):
    """Conversations, trimmed, as chat bodies, converted and read back: a row for each text."""
    said = conversations.trim_by_count(_read(spark, sf_dir, "conversations"))
    limit = F.lit(64)
    bodies = adapters.chat_bodies(said, F.lit("models/m-1"), {"max_tokens": limit, "stop": F.lit(None).cast("string")})
    made = adapters.to_gemini(bodies).select("conv_id", adapters.target(F.get_json_object("body", "$.model"), F.lit(False)).alias("target"), F.from_json("payload", _GEMINI).alias("p"))
    rows = made.select("conv_id", "target", F.posexplode("p.contents").alias("position", "c"), F.array_join("p.systemInstruction.parts.text", "|").alias("system"), "p.generationConfig")
    return rows.select(
        "conv_id", "target", F.col("position").cast("long").alias("position"), "c.role", F.col("c.parts")[0]["text"].alias("text"), "system", "generationConfig.maxOutputTokens", F.col("generationConfig.stopSequences").isNull().alias("no_stop")
    )


_GEMINI = "contents array<struct<role string, parts array<struct<text string>>>>, systemInstruction struct<parts array<struct<text string>>>, generationConfig struct<maxOutputTokens long, stopSequences string>"


def _order_key():
    return F.col("o_orderkey").cast("string")


def chat_content(spark, sf_dir):
    """For each order a body with a list content, a tool call and its answer; some roles are unknown."""
    key = _order_key()
    robot = F.when(F.col("o_orderkey") % 7 == 0, "robot").otherwise("user")
    body = F.concat(
        F.lit('{"model":"m","messages":[{"role":"system","content":"be brief"},{"role":"'), robot, F.lit('","content":[{"type":"text","text":"order '), key,
        F.lit('"},{"type":"image_url","image_url":{"url":"x"}}]},{"role":"assistant","content":null,"tool_calls":[{"id":"call-'), key,
        F.lit('","type":"function","function":{"name":"find","arguments":"{}"}}]},{"role":"tool","tool_call_id":"call-'), key, F.lit('","content":"status '), F.col("o_orderstatus"), F.lit('"}]}'),
    )
    made = adapters.content(_read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")), "o_orderkey")
    return made.select("o_orderkey", F.col("message").cast("long").alias("message"), F.col("item").cast("long").alias("item"), "role", "classification", "kind", "call_id", "name", "text", "error")


def gemini_answers(spark, sf_dir):
    """For each order an answer in two parts; a third has no finish reason, some have no candidate."""
    key = _order_key()
    told = F.concat(F.lit('[{"content":{"parts":[{"text":"order "},{"x":1},{"text":"'), key, F.lit('"}]}'), F.when(F.col("o_orderkey") % 3 == 0, "}]").otherwise(',"finishReason":"MAX_TOKENS"}]'))
    body = F.concat(F.lit('{"candidates":'), F.when(F.col("o_orderkey") % 5 == 0, "[]").otherwise(told), F.lit(',"usageMetadata":{"promptTokenCount":'), key, F.lit("}}"))
    made = adapters.from_gemini(_read(spark, sf_dir, "orders").select("o_orderkey", body.alias("payload")), F.lit("m"))
    return made.select("o_orderkey", "answer.*")


def assistant_messages(spark, sf_dir):
    """What a history keeps of an answer for each order; of some the role or all content is wrong."""
    key = _order_key()
    role = F.when(F.col("o_orderkey") % 5 == 0, "user").otherwise("assistant")
    kept = F.when(F.col("o_orderkey") % 7 == 0, '"audio":1').otherwise(F.concat(F.lit('"content":"order '), key, F.lit('","audio":1')))
    body = F.concat(F.lit('{"choices":[{"message":{"role":"'), role, F.lit('",'), kept, F.lit("}}]}"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", adapters.assistant_message(body).alias("kept"))


def protocol_errors(spark, sf_dir):
    """For each order a body whose model, role, tool name or format may be of a wrong form."""
    n = F.col("o_orderkey")
    pick = lambda k, bad, good: F.when(n % k == 0, bad).otherwise(good)
    body = F.concat(
        F.lit('{"model":"'), pick(3, "a model", "openai/m:1"), F.lit('","messages":[{"role":"'), pick(5, "robot", "user"), F.lit('","content":"free text!"}],"tools":[{"type":"'), pick(7, "code", "function"),
        F.lit('","function":{"name":"'), pick(11, "no name", "find"), F.lit('"}}],"response_format":{"type":"'), pick(13, "xml", "text"), F.lit('"}}'),
    )
    return adapters.protocol_errors(_read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")), "o_orderkey").select("o_orderkey", "path")


def stream_buffered(spark, sf_dir):
    """Messages as chunks of 16 characters; those of odd turns are arguments of a second tool."""
    said = _read(spark, sf_dir, "conversations").withColumn("text", F.concat(F.coalesce("role", F.lit("")), F.lit(" "), "text"))
    parts = conversations.fragments(said)
    content = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("fragment").alias("content")).alias("delta"))).alias("choices")))
    tool = F.struct(F.struct(F.lit("").alias("arguments")).alias("function")), F.struct(F.struct(F.col("fragment").alias("arguments")).alias("function"))
    called = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(*tool).alias("tool_calls")).alias("delta"))).alias("choices")))
    made = parts.select(F.concat_ws(":", "conv_id", "turn").alias("stream_id"), "seq", F.when(F.col("turn") % 2 == 1, called).otherwise(content).alias("chunk"))
    return adapters.buffered(made).select("stream_id", "field", "text")


def conversation_lives(spark, sf_dir):
    """Events as messages of their users' conversations by type, which end after two hours of silence."""
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("conv_id"), F.col("event_id").alias("seq"), "ts")
    return adapters.kept_histories(events, 7200).select("seq", "life", "behind")


def stream_events(spark, sf_dir):
    """Messages as chunks of a stream; those that are not the assistant's are refused, odd turns are arguments of a tool."""
    said = _read(spark, sf_dir, "conversations")
    words = F.when(F.col("turn") % 2 == 0, F.col("text"))
    tool = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.struct(F.col("text").alias("arguments")).alias("function"))))
    delta = F.struct("role", words.alias("content"), tool.alias("tool_calls"))
    choice = F.struct(F.col("turn").alias("index"), delta.alias("delta"), F.when(F.col("text").endswith("."), "stop").alias("finish_reason"))
    chunks = said.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.to_json(F.struct(F.array(choice).alias("choices"))).alias("chunk"))
    return adapters.stream_events(chunks).select("stream_id", "seq", F.col("event").cast("long").alias("event"), "kind", "choice", "field", "call_id", "text", "error")


def chat_rewritten(spark, sf_dir):
    """Conversations, trimmed, as chat bodies, taken apart, written again and read: a row for each message."""
    said = conversations.trim_by_count(_read(spark, sf_dir, "conversations"))
    rows = adapters.content(adapters.chat_bodies(said, F.lit("m")), "conv_id")
    again = adapters.content(adapters.bodies_of(rows, "conv_id", F.lit("m")), "conv_id")
    return again.select("conv_id", F.col("message").cast("long").alias("message"), "role", "kind", "text")


def vault_prune(spark, sf_dir):
    """Of a conversation's mappings (a token for a user's message, else the message's first word) those that answers still hold."""
    said = _read(spark, sf_dir, "conversations").where("text is not null and role is not null")
    token = F.concat(F.lit("<MG_r_USER_"), F.col("turn").cast("string"), F.lit(">"))
    put = F.when(F.col("role") == "user", token).otherwise(F.regexp_extract("text", r"\A([^ \n]*)", 1))
    table = said.select(F.col("conv_id").alias("scope_id"), F.col("role").alias("entity_type"), F.col("turn").cast("string").alias("original"), put.alias("replacement"), (F.col("role") != "assistant").alias("restore"))
    answers = said.where(F.col("role") == "assistant").select(F.col("conv_id").alias("scope_id"), F.concat(F.col("text"), F.lit(" <MG_r_USER_"), (F.col("turn") - 1).cast("string"), F.lit(">")).alias("text"))
    return mask.pruned(table, answers).select("scope_id", "entity_type", "original", "replacement")


def bearer_checks(spark, sf_dir):
    """Customers who ask by their name; the names of those without debts are keys, and one segment uses another scheme."""
    asked = _read(spark, sf_dir, "customer").withColumn("authorization", F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "Basic ").otherwise("bearer "), F.col("c_name")))
    return gateway.admitted(asked, asked.where("c_acctbal >= 0").select(F.col("c_name").alias("key"))).select("c_custkey", "admitted")


def log_lines(spark, sf_dir):
    """Events as log lines; those of views name their properties in place of an event."""
    events = _read(spark, sf_dir, "events").withColumn("message", F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.col("event_type"))).withColumn("request_id", F.col("user_id").cast("string"))
    return events.select("event_id", gateway.log_line(events).alias("line"))


def _turns(protocol):
    def run(spark, sf_dir):
        """Conversations as bodies of a protocol, read again; some assistants' turns are calls. A row for each item or refused body."""
        said = _read(spark, sf_dir, "conversations")
        called = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
        place = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("message")
        rows = said.select(
            "conv_id", place, F.lit(0).alias("item"), F.coalesce("role", F.lit("user")).alias("role"), F.when(called, "tool_call").otherwise("text").alias("kind"), F.when(called, F.concat(F.lit("c"), "turn")).alias("call_id"),
            F.when(called, "find").alias("name"), F.when(called, F.to_json(F.struct("turn"))).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.lit(None).cast("string").alias("error"),
        )
        made = cut(turns.bodies_of(rows, protocol, F.lit("m"), "conv_id"))
        told = turns.content(made.where("error is null"), protocol, "conv_id").select("conv_id", F.col("message").cast("long").alias("message"), F.col("item").cast("long").alias("item"), "role", "classification", "kind", "call_id", "name", "text", "error")
        return told.unionByName(made.where("error is not null").select("conv_id", "error"), allowMissingColumns=True)

    run.__name__ = f"{protocol}_turns"
    return run


def _turns_sql(late: str) -> str:
    return f"""
        with q as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as m, coalesce(role, 'user') as role, coalesce(role = 'assistant' and turn % 4 = 3, false) as called, turn, coalesce(text, '') as text from conversations),
        r as (select *, role = 'system' as s, count(*) filter (role = 'system') over w as before, bool_or(role = 'system') over (partition by conv_id) as told from q window w as (partition by conv_id order by m rows between unbounded preceding and 1 preceding)),
        e as (select conv_id, min(m) filter (s and {late}) as bad from r group by conv_id),
        n as (select r.*, row_number() over (partition by conv_id, s order by m) - 1 as k from r)
        select conv_id, case when s then 0 else k + told::bigint end as message, case when s then k else 0 end as item, role, case role when 'system' then 'instruction' when 'assistant' then 'assistant_text' else 'user_text' end as classification,
          case when called then 'tool_call' else 'text' end as kind, case when called then 'c' || turn end as call_id, case when called then 'find' end as name, case when called then '{{"turn":' || turn || '}}' else text end as text, null as error from n join e using (conv_id) where bad is null
        union all select conv_id, null, null, null, null, null, null, null, null, '$.turns[' || bad || ']' from e where bad is not null"""


def request_settings(spark, sf_dir):
    """For each order a body with settings of its columns; some are of a wrong kind, unknown, or ask to store."""
    n = F.col("o_orderkey")
    pick = lambda k, bad, good: F.when(n % k == 0, bad).otherwise(good)
    body = F.concat(
        F.lit('{"model":"m","input":"order","max_output_tokens":'), pick(3, F.lit('"many"'), n.cast("string")), F.lit(',"temperature":'), pick(5, F.lit("true"), (n % 4).cast("string")),
        F.lit(',"stream":'), pick(2, F.lit("true"), F.lit("false")), F.lit(',"store":'), pick(7, F.lit("true"), F.lit("null")), pick(11, F.lit(',"seed":1'), F.lit("")), F.lit(',"trace":"'), F.col("o_orderstatus"), F.lit('"}'),
    )
    made = settings.settings(_read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")), "responses", "o_orderkey", extensions=("trace",))
    return made.select("o_orderkey", "model", "max_tokens", "temperature", "stream", "store", "extensions", "error")


def request_tools(spark, sf_dir):
    """For each part a body with two tools; some are the provider's own, or have an unknown member or no schema."""
    n = F.col("p_partkey")
    pick = lambda k, bad, good: F.when(n % k == 0, bad).otherwise(good)
    first = F.concat(F.lit('{"name":"find_'), n, F.lit('","description":"'), F.col("p_brand"), F.lit('"'), pick(5, F.lit(',"cache":1'), F.lit("")), pick(7, F.lit(""), F.lit(',"input_schema":{"type":"object"}')), F.lit("}"))
    second = pick(3, F.lit('{"type":"search","name":"s"}'), F.lit('{"name":"s","input_schema":{},"strict":true}'))
    made = settings.tools(_read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"tools":['), first, F.lit(","), second, F.lit("]}")).alias("body")), "messages", "p_partkey")
    return made.select("p_partkey", F.col("tool").cast("long").alias("tool"), "name", "description", "schema", "strict", "error")


def history_appended(spark, sf_dir):
    """Conversations' even turns as what is stored, their odd ones as new messages."""
    said = _read(spark, sf_dir, "conversations")
    return conversations.appended(said.where("turn % 2 = 0"), said.where("turn % 2 = 1")).select("conv_id", "position", "role", "text")


LATE = {"messages": "before < m", "generate": "before < m", "responses": "before > 0", "interactions": "m > 0"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (chat_to_gemini, chat_content, gemini_answers, assistant_messages, protocol_errors, stream_buffered, conversation_lives, stream_events, chat_rewritten, vault_prune, bearer_checks, log_lines, request_settings, request_tools, history_appended, *map(_turns, turns.PROTOCOLS))}


def oracle_sql() -> dict[str, str]:
    return {
        "chat_to_gemini": """
            with r as (select *, coalesce(role = 'system', false) as s, count(*) over (partition by conv_id) as n from conversations),
            r2 as (select *, row_number() over (partition by conv_id, s order by turn) as a, row_number() over (partition by conv_id, s order by turn desc) as z from r),
            k as (select * from r2 where (n <= 40 or (s and a <= 2) or (not s and z <= 38)) and text is not null),
            y as (select conv_id, string_agg(text, '|' order by turn) as system from k where s group by conv_id)
            select conv_id, '/models/m-1:generateContent' as target, row_number() over (partition by conv_id order by turn) - 1 as position, case when role = 'assistant' then 'model' else 'user' end as role, text, system, 64::bigint as maxOutputTokens, true as no_stop
            from k left join y using (conv_id) where not s""",
        "chat_content": """
            with o as (select o_orderkey, case when o_orderkey % 7 = 0 then 'robot' else 'user' end as asked, 'call-' || o_orderkey as call, o_orderstatus from orders)
            select o_orderkey, 0::bigint as message, 0::bigint as item, 'system' as role, 'instruction' as classification, 'text' as kind, null as call_id, null as name, 'be brief' as text, null as error from o
            union all select o_orderkey, 1, 0, asked, 'user_text', 'text', null, null, 'order ' || o_orderkey, case when asked = 'robot' then '$.messages[1].role' end from o
            union all select o_orderkey, 1, 1, asked, 'user_text', 'unsupported', null, null, null, case when asked = 'robot' then '$.messages[1].role' else '$.messages[1].content[1]' end from o
            union all select o_orderkey, 2, 0, 'assistant', 'assistant_text', 'tool_call', call, 'find', '{}', null from o
            union all select o_orderkey, 3, 0, 'tool', 'tool_result', 'text', call, null, 'status ' || o_orderstatus, null from o""",
        "gemini_answers": """
            select o_orderkey, 'm' as model, case when o_orderkey % 5 = 0 then '' else 'order ' || o_orderkey end as content, case when o_orderkey % 5 = 0 or o_orderkey % 3 = 0 then 'stop' else 'max_tokens' end as finish_reason,
              o_orderkey as prompt_tokens, 0::bigint as completion_tokens, 0::bigint as total_tokens from orders""",
        "assistant_messages": """
            select o_orderkey, case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 then '{"role":"assistant","content":"order ' || o_orderkey || '"}' end as kept from orders""",
        "protocol_errors": """
            with e(k, path) as (values (3, '$.model'), (5, '$.messages[0].role'), (7, '$.tools[0].type'), (11, '$.tools[0].function.name'), (13, '$.response_format.type'))
            select o_orderkey, path from orders join e on o_orderkey % k = 0""",
        "stream_buffered": """
            select conv_id || ':' || turn as stream_id, case when turn % 2 = 1 then 'tool_calls[1]' else 'content' end as field, coalesce(role, '') || ' ' || text as text from conversations where text is not null""",
        "conversation_lives": """
            with a as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id, event_type order by ts, event_id) as since from events),
            b as (select *, cast(sum(case when since >= 7200000000 then 1 else 0 end) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as bigint) as life from a)
            select event_id as seq, life, row_number() over (partition by user_id, event_type, life order by ts, event_id) - 1 as behind from b""",
        "stream_events": """
            with c as (select conv_id as stream_id, turn as seq, turn as choice, turn % 2 as odd, text, coalesce(role = 'assistant', role is null) as ok from conversations),
            e as (select *, 0 as last from c where text is not null and ok union all select *, 1 from c where suffix(text, '.') and ok)
            select stream_id, seq, row_number() over (partition by stream_id, seq order by last) - 1 as event, case when last = 1 then 'finish' when odd = 1 then 'arguments' else 'text' end as kind, choice,
              case when last = 1 then null when odd = 1 then 'tool_calls[0].function.arguments' else 'content' end as field, case when last = 0 and odd = 1 then 'choice-' || choice || '-tool-0' end as call_id, case when last = 1 then 'stop' else text end as text, null as error from e
            union all select stream_id, seq, 0, 'refused', null, null, null, null, '$.choices[0].delta.role' from c where not ok""",
        "chat_rewritten": """
            with r as (select *, coalesce(role = 'system', false) as s, count(*) over (partition by conv_id) as n from conversations),
            r2 as (select *, row_number() over (partition by conv_id, s order by turn) as a, row_number() over (partition by conv_id, s order by turn desc) as z from r)
            select conv_id, row_number() over (partition by conv_id order by turn) - 1 as message, coalesce(role, 'user') as role, case when text is not null then 'text' end as kind, text from r2 where n <= 40 or (s and a <= 2) or (not s and z <= 38)""",
        "vault_prune": r"""
            with t as (select conv_id as scope_id, role as entity_type, turn::varchar as original, case when role = 'user' then '<MG_r_USER_' || turn || '>' else regexp_extract(text, '\A([^ \n]*)', 1) end as replacement from conversations where text is not null and role <> 'assistant')
            select * from t where replacement <> '' and exists (select 1 from conversations c where c.conv_id = t.scope_id and c.role = 'assistant' and contains(c.text || ' <MG_r_USER_' || (c.turn - 1) || '>', t.replacement))""",
        "bearer_checks": """
            select c_custkey, c_mktsegment <> 'BUILDING' and c_name in (select c_name from customer where c_acctbal >= 0) as admitted from customer""",
        "log_lines": """
            select event_id, '{"message":"' || case when event_type = 'view' then 'log_suppressed' else event_type end || '","request_id":"' || user_id || '"}' as line from events""",
        "request_settings": """
            with e as (select *, case when o_orderkey % 11 = 0 then '$.seed' when o_orderkey % 3 = 0 then '$.max_output_tokens' when o_orderkey % 5 = 0 then '$.temperature' when o_orderkey % 7 = 0 then '$.store' end as error from orders)
            select o_orderkey, case when error is null then 'm' end as model, case when error is null then o_orderkey end as max_tokens, case when error is null then (o_orderkey % 4)::double end as temperature, case when error is null then o_orderkey % 2 = 0 end as stream,
              case when error is null then false end as store, case when error is null then '{"trace":"' || o_orderstatus || '"}' end as extensions, error from e""",
        "history_appended": "select conv_id, row_number() over (partition by conv_id order by turn % 2, turn, role, text) - 1 as position, role, text from conversations where turn is not null",
        "request_tools": """
            with e as (select *, case when p_partkey % 5 = 0 then '$.tools[0]' when p_partkey % 7 = 0 then '$.tools[0].input_schema' end as e0, case when p_partkey % 3 = 0 then '$.tools[1]' end as e1 from part)
            select p_partkey, 0::bigint as tool, case when e0 is null then 'find_' || p_partkey end as name, case when e0 is null then p_brand end as description, case when e0 is null then '{"type":"object"}' end as schema, case when e0 is null then false end as strict, e0 as error from e
            union all select p_partkey, 1, case when e1 is null then 's' end, case when e1 is null then '' end, case when e1 is null then '{}' end, case when e1 is null then true end, e1 from e""",
    } | {f"{p}_turns": _turns_sql(late) for p, late in LATE.items()}
