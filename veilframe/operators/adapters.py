"""Provider formats: chat bodies as rows of content, and their conversion to and from generate-content bodies.

Bodies are read as variants, so that a member that may be a text or a list is told apart by
expressions alone; a body is worked on where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .wire import flatten

# Strings that protocols need, by their member names, and what they may be.
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
MODEL = r"\A[A-Za-z0-9][A-Za-z0-9._:/-]{0,255}\z"
TARGET_MODEL = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
PROTOCOL_LENGTH = 256
FREE = ("modalities", "reasoning_effort", "service_tier", "audio.format", "audio.voice", "messages.content.type")
IDENTIFIERS = ("messages.tool_call_id", "messages.tool_calls.id", "messages.tool_calls.function.name", "tools.function.name", "functions.name")
WORDS = {
    "messages.role": ("assistant", "developer", "function", "system", "tool", "user"),
    "messages.tool_calls.type": ("function",),
    "tools.type": ("function",),
    "response_format.type": ("json_object", "json_schema", "text"),
}
DELTA = ("role", "content", "refusal", "function_call", "tool_calls")
TOOL_DELTA = ("index", "id", "type", "function")
FUNCTION_DELTA = ("name", "arguments")
DEFAULT_MODEL = "gemini-2.5-flash"
SETTINGS = {"temperature": "temperature", "top_p": "topP", "max_tokens": "maxOutputTokens", "stop": "stopSequences"}
# Fixed values end.


def classification(role: Column) -> Column:
    """What a role's text is; roles that are not known count as the user's."""
    return F.when(role.isin("system", "developer"), "instruction").when(role == "assistant", "assistant_text").when(role == "tool", "tool_result").otherwise("user_text")


def protocol_form(name: Column, value: Column) -> Column:
    """Whether a string at the member path ``name`` is of the form that its protocol needs; null where it needs none."""
    fits = F.when(name == "model", value.rlike(MODEL)).when(name.isin(*IDENTIFIERS), value.rlike(IDENTIFIER)).when(name.isin(*FREE), F.length(value) <= PROTOCOL_LENGTH)
    for path, words in WORDS.items():
        fits = fits.when(name == path, value.isin(*words))
    return fits


def protocol_errors(bodies: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """``key``, ordinal, path of the strings that a protocol needs and that are not of its form.

    Other strings are content and not judged here. A body that is no JSON object has no rows.
    """
    fits = protocol_form(F.col("keys"), F.col("text"))
    return flatten(bodies, key, body).where((F.col("kind") == "string") & ~F.col("nested")).where(~fits).select(key, "ordinal", "path")


def chat_bodies(messages: DataFrame, model: Column, settings: dict[str, Column] | None = None) -> DataFrame:
    """conv_id, body: a chat body of each conversation's messages (conv_id, turn, role, text) in order.

    A body is one row, so trim conversations first. A null text is a null content.
    """
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    kept = F.transform(said, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    made = messages.groupBy("conv_id").agg(kept.alias("messages"))
    given = [c.alias(n) for n, c in (settings or {}).items()]
    return made.select("conv_id", F.to_json(F.struct(model.alias("model"), "messages", *given)).alias("body"))


def _kind(member: str) -> str:
    return f"schema_of_variant({member})"


_TEXTS = f"""case when {_kind("c.content")} = 'STRING' then array(variant_get(c.content, '$', 'string'))
  when {_kind("c.content")} like 'ARRAY%' then transform(
    filter(variant_get(c.content, '$', 'array<variant>'), p -> try_variant_get(p, '$.type', 'string') = 'text' and {_kind("try_variant_get(p, '$.text', 'variant')")} = 'STRING'),
    p -> variant_get(p, '$.text', 'string')) else array() end"""


def _messages(body: Column) -> Column:
    """The messages of a parsed body as array of (role, content), where content is a variant."""
    return F.transform(
        F.coalesce(F.try_variant_get(body, "$.messages", "array<variant>"), F.array().cast("array<variant>")),
        lambda m: F.struct(F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("user")).alias("role"), F.try_variant_get(m, "$.content", "variant").alias("content"), m.alias("whole")),
    )


def model_name(model: Column) -> Column:
    """A model's name without ``models/``; null if it holds characters that no name has."""
    name = F.regexp_replace(F.coalesce(F.nullif(model, F.lit("")), F.lit(DEFAULT_MODEL)), r"\Amodels/", "")
    return F.when(name.rlike(TARGET_MODEL), name)


def target(model: Column, stream: Column) -> Column:
    """Where a generate-content request goes; null for a model name that is refused."""
    return F.concat(F.lit("/models/"), model_name(model), F.when(stream, ":streamGenerateContent?alt=sse").otherwise(":generateContent"))


def to_gemini(bodies: DataFrame, body: str = "body", into: str = "payload") -> DataFrame:
    """``bodies`` plus the same request as a generate-content body; null for what is no JSON.

    Texts of the system go apart from the others, in order; of list contents only text parts
    go over, and messages without any text part are left out. Settings keep their values; null
    ones are left out.
    """
    read = bodies.withColumn("_v", F.try_parse_json(body)).withColumn("_m", _messages(F.col("_v")))
    read = read.withColumn("_m", F.expr(f"filter(transform(_m, c -> struct(c.role as role, {_TEXTS} as texts)), c -> size(c.texts) > 0)"))
    part = lambda t: F.struct(t.alias("text"))
    parts = lambda m: F.transform(m["texts"], part).alias("parts")
    others = F.filter("_m", lambda m: m["role"] != "system")
    contents = F.transform(others, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), parts(m)))
    system = F.flatten(F.transform(F.filter("_m", lambda m: m["role"] == "system"), lambda m: F.transform(m["texts"], part)))
    values = {new: F.try_variant_get("_v", f"$.{old}", "variant") for old, new in SETTINGS.items()}
    values = {n: F.when(~F.is_variant_null(c), c) for n, c in values.items()}
    config = F.when(F.coalesce(*[F.when(c.isNotNull(), True) for c in values.values()]), F.struct(*[c.alias(n) for n, c in values.items()]))
    whole = F.struct(contents.alias("contents"), F.when(F.size(system) > 0, F.struct(system.alias("parts"))).alias("systemInstruction"), config.alias("generationConfig"))
    return read.withColumn(into, F.when(F.col("_v").isNotNull(), F.to_json(whole))).drop("_v", "_m")


def from_gemini(answers: DataFrame, model: Column, payload: str = "payload", into: str = "answer") -> DataFrame:
    """``answers`` plus a generate-content answer as (model, content, finish_reason, and three counts of tokens).

    The first candidate's texts are joined; what is missing is empty, ``stop`` and 0.
    """
    read = answers.withColumn("_v", F.try_parse_json(payload))
    texts = F.transform(F.coalesce(F.try_variant_get("_v", "$.candidates[0].content.parts", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    count = lambda n: F.coalesce(F.try_variant_get("_v", f"$.usageMetadata.{n}", "long"), F.lit(0)).cast("long")
    made = F.struct(
        model.alias("model"),
        F.array_join(texts, "").alias("content"),
        F.lower(F.coalesce(F.try_variant_get("_v", "$.candidates[0].finishReason", "string"), F.lit("STOP"))).alias("finish_reason"),
        count("promptTokenCount").alias("prompt_tokens"),
        count("candidatesTokenCount").alias("completion_tokens"),
        count("totalTokenCount").alias("total_tokens"),
    )
    return read.withColumn(into, made).drop("_v")


def assistant_message(answer: Column) -> Column:
    """The first choice's message with the members that a history keeps, as JSON; null if it is not the assistant's or has none."""
    said = F.try_variant_get(F.try_parse_json(answer), "$.choices[0].message", "variant")
    kept = {n: F.try_variant_get(said, f"$.{n}", "variant") for n in ("content", "refusal", "function_call", "tool_calls")}
    some = F.coalesce(*[F.when(c.isNotNull(), True) for c in kept.values()])
    return F.when((F.try_variant_get(said, "$.role", "string") == "assistant") & some, F.to_json(F.struct(F.lit("assistant").alias("role"), *[c.alias(n) for n, c in kept.items()])))


def content(bodies: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """``key``, message, item, role, classification, kind, call_id, name, text, error: a chat body's content, a row each.

    kind: text, refusal, tool_call or unsupported. A tool call's text is its arguments; a tool's
    text has the call that it answers as call_id. ``error`` is the path of what no chat body may
    hold: an unknown role or part. Bodies without messages have no rows; a message without content has one with nulls.
    """
    read = bodies.select(key, F.try_parse_json(body).alias("_v")).select(key, F.posexplode(_messages(F.col("_v"))).alias("message", "m"))
    part = lambda kind, text, call=F.lit(None), name=F.lit(None): F.struct(kind.alias("kind"), call.cast("string").alias("call_id"), name.cast("string").alias("name"), text.cast("string").alias("text"))
    none = F.array().cast("array<struct<kind:string,call_id:string,name:string,text:string>>")
    whole, said = F.col("m.whole"), F.col("m.content")
    shape = F.schema_of_variant(said)
    answered = F.try_variant_get(whole, "$.tool_call_id", "string")

    def of_list(p: Column) -> Column:
        kind = F.try_variant_get(p, "$.type", "string")
        known = F.when(kind.isin("text", "refusal"), kind).otherwise("unsupported")
        return part(known, F.when(kind == "text", F.try_variant_get(p, "$.text", "string")).when(kind == "refusal", F.try_variant_get(p, "$.refusal", "string")), answered)

    texts = (
        F.when(shape == "STRING", F.array(part(F.lit("text"), F.try_variant_get(said, "$", "string"), answered)))
        .when(shape.startswith("ARRAY"), F.transform(F.try_variant_get(said, "$", "array<variant>"), of_list))
        .when(shape.isNull() | (shape == "VOID"), none)
        .otherwise(F.array(part(F.lit("unsupported"), F.lit(None))))
    )
    refusal = F.try_variant_get(whole, "$.refusal", "string")
    calls = F.transform(
        F.coalesce(F.try_variant_get(whole, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: part(F.lit("tool_call"), F.try_variant_get(c, "$.function.arguments", "string"), F.try_variant_get(c, "$.id", "string"), F.try_variant_get(c, "$.function.name", "string")),
    )
    items = F.concat(texts, F.when(refusal.isNotNull(), F.array(part(F.lit("refusal"), refusal))).otherwise(none), calls)
    rows = read.select(key, "message", F.col("m.role").alias("role"), F.posexplode_outer(items).alias("item", "i"))
    place = F.concat(F.lit("$.messages["), "message", F.lit("]"))
    error = F.when(~F.col("role").isin(*WORDS["messages.role"]), F.concat(place, F.lit(".role"))).when(F.col("i.kind") == "unsupported", F.concat(place, F.lit(".content["), "item", F.lit("]")))
    return rows.select(key, "message", "item", "role", classification(F.col("role")).alias("classification"), "i.kind", "i.call_id", "i.name", "i.text", error.alias("error"))


def buffered(events: DataFrame) -> DataFrame:
    """stream_id, choice, field, text: what a stream's chunks give for each field of each choice, once it is complete.

    ``events`` has stream_id, seq and chunk (JSON). Fields are content, refusal, function_call
    and tool_calls[i]; texts are for the guards of whole texts, so nothing is shown in parts.
    Empty texts give no row.
    """
    read = events.select("stream_id", "seq", F.try_parse_json("chunk").alias("_v"))
    choices = read.select("stream_id", "seq", F.posexplode(F.try_variant_get("_v", "$.choices", "array<variant>")).alias("choice", "c"))
    got = lambda path: F.try_variant_get("c", path, "variant")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    one = lambda name, v: F.struct(F.lit(name).alias("field"), text(v).alias("text"))
    tools = F.transform(
        F.coalesce(F.try_variant_get("c", "$.delta.tool_calls", "array<variant>"), F.array().cast("array<variant>")),
        lambda t, i: F.struct(F.concat(F.lit("tool_calls["), i, F.lit("]")).alias("field"), text(F.try_variant_get(t, "$.function.arguments", "variant")).alias("text")),
    )
    fields = F.concat(F.array(one("content", got("$.delta.content")), one("refusal", got("$.delta.refusal")), one("function_call", got("$.delta.function_call.arguments"))), tools)
    each = choices.select("stream_id", "seq", "choice", F.inline(fields)).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return each.groupBy("stream_id", "choice", "field").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def stream_events(chunks: DataFrame, structured: bool = False) -> DataFrame:
    """stream_id, seq, event, kind, choice, field, call_id, text, error: the typed events of a stream's chunks.

    ``chunks`` has stream_id, seq and chunk (JSON). kind: text (structured, if ``structured`` is
    asked for and the field is content), arguments, finish, failure (the provider's own error:
    call_id is its code) or refused. A chunk that holds anything unknown or of a wrong kind
    gives nothing but one refused row, whose ``error`` is the path of its first fault. Chunks are
    judged one by one, without a shuffle.
    """
    read = chunks.select("stream_id", "seq", F.try_parse_json("chunk").alias("_v"))
    kind_of = lambda v: F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0), F.lit(""))
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    string = lambda v: F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))
    given = lambda v: v.isNotNull() & (kind_of(v) != "VOID")
    shown = lambda v: F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")).when(given(v), F.to_json(v))
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    no_text = lambda v: given(v) & (kind_of(v) != "STRING")

    def alien(v: Column, allowed: tuple[str, ...]) -> Column:
        return F.try_element_at(F.array_sort(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, allowed)))), F.lit(1))

    def function_fault(f: Column, path: Column) -> Column:
        return F.when(kind_of(f) != "OBJECT", path).when(alien(f, FUNCTION_DELTA).isNotNull(), path).when(no_text(at(f, "$.arguments")), F.concat(path, F.lit(".arguments")))

    def tool_fault(t: Column, path: Column) -> Column:
        f = at(t, "$.function")
        return F.when(kind_of(t) != "OBJECT", path).when(alien(t, TOOL_DELTA).isNotNull(), path).when(f.isNotNull(), function_fault(f, F.concat(path, F.lit(".function"))))

    def fault(c: Column, i: Column) -> Column:
        path = F.concat(F.lit("$.choices["), i, F.lit("]"))
        index, delta = at(c, "$.index"), at(c, "$.delta")
        under = lambda name: F.concat(path, F.lit(".delta." + name))
        role, call, tools = (at(delta, f"$.{n}") for n in ("role", "function_call", "tool_calls"))
        of_tools = F.filter(F.transform(items(tools), lambda t, j: tool_fault(t, F.concat(under("tool_calls["), j, F.lit("]")))), lambda e: e.isNotNull())
        out = F.when(kind_of(c) != "OBJECT", path).when(index.isNotNull() & (kind_of(index) != "BIGINT"), F.concat(path, F.lit(".index"))).when(delta.isNotNull() & (kind_of(delta) != "OBJECT"), F.concat(path, F.lit(".delta")))
        out = out.when(alien(delta, DELTA).isNotNull(), F.concat(under(""), alien(delta, DELTA))).when(role.isNotNull() & F.coalesce(string(role) != "assistant", F.lit(True)), under("role"))
        out = out.when(no_text(at(delta, "$.content")), under("content")).when(no_text(at(delta, "$.refusal")), under("refusal"))
        wrong = F.when(given(call), function_fault(call, under("function_call")))
        return out.when(wrong.isNotNull(), wrong).when(tools.isNotNull() & (kind_of(tools) != "ARRAY"), under("tool_calls")).otherwise(F.try_element_at(of_tools, F.lit(1)))

    def event(kind, choice, field, call_id, text, error=F.lit(None)) -> Column:
        named = zip(("kind", "field", "call_id", "text", "error"), (kind, field, call_id, text, error), strict=True)
        return F.struct(choice.cast("long").alias("choice"), *[c.cast("string").alias(n) for n, c in named])

    null = F.lit(None)

    def made(c: Column, i: Column) -> Column:
        index = F.coalesce(F.try_variant_get(c, "$.index", "long"), i.cast("long"))
        call, named = at(c, "$.delta.function_call"), lambda v: F.nullif(shown(v), F.lit(""))
        first = F.array(
            event(F.lit("structured" if structured else "text"), index, F.lit("content"), null, string(at(c, "$.delta.content"))),
            event(F.lit("text"), index, F.lit("refusal"), null, string(at(c, "$.delta.refusal"))),
            event(F.lit("arguments"), index, F.lit("function_call.arguments"), F.coalesce(named(at(call, "$.name")), F.concat(F.lit("choice-"), index, F.lit("-legacy-function"))), string(at(call, "$.arguments"))),
        )

        def of_tool(t: Column, j: Column) -> Column:
            number = F.coalesce(shown(at(t, "$.index")), j.cast("string"))
            call_id = F.coalesce(named(at(t, "$.id")), F.concat(F.lit("choice-"), index, F.lit("-tool-"), number))
            return event(F.lit("arguments"), index, F.concat(F.lit("tool_calls["), number, F.lit("].function.arguments")), call_id, string(at(t, "$.function.arguments")))

        last = F.array(event(F.lit("finish"), index, null, null, shown(at(c, "$.finish_reason"))))
        return F.filter(F.concat(first, F.transform(items(at(c, "$.delta.tool_calls")), of_tool), last), lambda e: e["text"].isNotNull())

    failure, choices = at(F.col("_v"), "$.error"), at(F.col("_v"), "$.choices")
    faults = F.filter(F.transform(items(choices), fault), lambda e: e.isNotNull())
    wrong = (
        F.when(kind_of(F.col("_v")) != "OBJECT", "$")
        .when(failure.isNotNull(), F.when(kind_of(failure) != "OBJECT", "$.error"))
        .when(kind_of(choices) != "ARRAY", "$.choices")
        .otherwise(F.try_element_at(faults, F.lit(1)))
    )
    told = F.array(event(F.lit("failure"), null, null, F.coalesce(shown(at(failure, "$.code")), F.lit("provider_error")), F.coalesce(shown(at(failure, "$.message")), F.lit("provider error"))))
    judged = read.withColumn("_wrong", wrong)
    all_of = F.when(F.col("_wrong").isNotNull(), F.array(event(F.lit("refused"), null, null, null, null, F.col("_wrong")))).when(failure.isNotNull(), told).otherwise(F.flatten(F.transform(items(choices), made)))
    return judged.select("stream_id", "seq", F.posexplode(all_of).alias("event", "e")).select("stream_id", "seq", "event", "e.kind", "e.choice", "e.field", "e.call_id", "e.text", "e.error")


def bodies_of(rows: DataFrame, key: str = "request_id", model: Column | None = None) -> DataFrame:
    """``key``, body, error: chat bodies from the rows that :func:`content` gives of them.

    One text is a plain content, several are a list of parts, none is null; a tool's message
    names the call that it answers. Rows with an error, and calls outside an assistant's message,
    have no body but the path of the first such place. A body is one row, as it was.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", "$1")
    said = F.array_sort(F.collect_list(F.struct("item", "kind", "call_id", "name", "text", "error")))
    each = rows.groupBy(key, "message").agg(F.first("role").alias("role"), said.alias("items"))
    texts = F.filter("items", lambda i: i["kind"] == "text")
    calls = F.filter("items", lambda i: i["kind"] == "tool_call")
    refusals = F.filter("items", lambda i: i["kind"] == "refusal")
    part = lambda i: F.concat(F.lit('{"type":"text","text":'), quoted(F.coalesce(i["text"], F.lit(""))), F.lit("}"))
    call = lambda i: F.concat(F.lit('{"id":'), quoted(i["call_id"]), F.lit(',"type":"function","function":{"name":'), quoted(i["name"]), F.lit(',"arguments":'), quoted(i["text"]), F.lit("}}"))
    content_of = F.when(F.size(texts) == 0, "null").when(F.size(texts) == 1, quoted(texts[0]["text"])).otherwise(F.concat(F.lit("["), F.array_join(F.transform(texts, part), ","), F.lit("]")))
    members = F.concat_ws(
        ",",
        F.concat(F.lit('"role":'), quoted(F.col("role"))),
        F.when((F.col("role") == "tool") & F.col("items")[0]["call_id"].isNotNull(), F.concat(F.lit('"tool_call_id":'), quoted(F.col("items")[0]["call_id"]))),
        F.concat(F.lit('"content":'), content_of),
        F.when(F.size(refusals) > 0, F.concat(F.lit('"refusal":'), quoted(refusals[0]["text"]))),
        F.when(F.size(calls) > 0, F.concat(F.lit('"tool_calls":['), F.array_join(F.transform(calls, call), ","), F.lit("]"))),
    )
    faults = F.filter(F.transform("items", lambda i: i["error"]), lambda e: e.isNotNull())
    place = F.concat(F.lit("$.messages["), "message", F.lit("].tool_calls"))
    wrong = F.coalesce(F.try_element_at(faults, F.lit(1)), F.when((F.size(calls) > 0) & (F.col("role") != "assistant"), place))
    made = each.select(key, "message", F.concat(F.lit("{"), members, F.lit("}")).alias("m"), wrong.alias("wrong"))
    whole = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("message", "m"))).alias("all"), F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("message"))).alias("error"))
    head = F.lit("") if model is None else F.concat(F.lit('"model":'), quoted(model), F.lit(","))
    body = F.concat(F.lit("{"), head, F.lit('"messages":['), F.array_join(F.transform("all", lambda a: a["m"]), ","), F.lit("]}"))
    return whole.select(key, F.when(F.col("error").isNull(), body).alias("body"), "error")


def kept_histories(messages: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """``messages`` (owner, conv_id, seq, ts) plus life and behind: which life of its conversation a message is in, and the messages before it there.

    A conversation is an owner's: one id of two owners is two. It ends once ``ttl_seconds`` have
    passed since its last message; the next one begins a new life with no history. One
    conversation's messages are ordered in one task.
    """
    order = Window.partitionBy("owner", "conv_id").orderBy("ts", "seq")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    since = at - F.lag(at).over(order)
    begun = messages.withColumn("_new", (F.coalesce(since, F.lit(0)) >= ttl_seconds * 1_000_000).cast("long"))
    lived = begun.withColumn("life", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    inside = Window.partitionBy("owner", "conv_id", "life").orderBy("ts", "seq")
    return lived.withColumn("behind", (F.row_number().over(inside) - 1).cast("long"))
