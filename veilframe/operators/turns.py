"""Requests of four other protocols as the rows of content that chat bodies give, and bodies from such rows.

A protocol is told by the shapes of its blocks, items or steps. Bodies are read as variants and
judged where they lie; only the writing of bodies groups rows, by request and turn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adapters import classification

# The protocols' members, roles and kinds of blocks.
MEMBERS = {
    "messages": ("model", "max_tokens", "messages", "system", "tools", "tool_choice", "output_config", "stream", "temperature", "top_p", "stop_sequences"),
    "responses": ("model", "input", "instructions", "tools", "tool_choice", "text", "stream", "store", "max_output_tokens", "temperature", "top_p"),
    "generate": ("model", "contents", "systemInstruction", "tools", "toolConfig", "generationConfig", "stream"),
    "interactions": ("model", "input", "system_instruction", "tools", "tool_choice", "response_format", "generation_config", "stream", "store", "previous_interaction_id"),
}
TURNS = {"messages": "messages", "responses": "input", "generate": "contents", "interactions": "input"}
SYSTEM = {"messages": "system", "responses": "instructions", "generate": "systemInstruction", "interactions": "system_instruction"}
SAID = ("system", "developer", "user", "assistant")
STEPS = {"user_input": "user", "model_output": "assistant"}
# Fixed values end.
PROTOCOLS = tuple(MEMBERS)
ITEM = "struct<kind:string,call_id:string,name:string,text:string,fault:string>"
TURN = f"struct<role:string,items:array<{ITEM}>,fault:string>"


@dataclass(frozen=True)
class Shape:
    """A kind of block: when one is meant, its members, and where its call, name and text are.

    ``text_kind``: STRING, OBJECT, JSON (a string that holds an object) or ANY.
    """

    meant: Column
    kind: str
    members: tuple[str, ...]
    text: str
    text_kind: str = "STRING"
    call_id: str | None = None
    name: str | None = None
    inside: str | None = None
    flag: str | None = None


def _at(v: Column, member: str) -> Column:
    return F.try_variant_get(v, f"$.{member}", "variant")


def _kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, BOOLEAN, VOID (a null) and so on; empty where there is nothing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0), F.lit(""))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _list(v: Column) -> Column:
    return F.coalesce(F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _members(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _exactly(v: Column, members: tuple[str, ...], optional: str | None = None) -> Column:
    found = F.array_sort(F.filter(_members(v), lambda m: m != optional) if optional else _members(v))
    return found == F.array(*[F.lit(m) for m in sorted(set(members) - {optional})])


def _item(kind, call_id=None, name=None, text=None, fault=None) -> Column:
    values = {"kind": kind, "call_id": call_id, "name": name, "text": text, "fault": fault}
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("string").alias(n) for n, c in values.items()])


def _block(v: Column, path: Column, shapes: list[Shape]) -> Column:
    """One item; a block that is of no shape, or not wholly of the one that it is meant to be, is refused by its path."""
    out = F.when(_kind(v) != "OBJECT", _item("refused", fault=path))
    for s in shapes:
        inner = _at(v, s.inside) if s.inside else v
        place = F.concat(path, F.lit(f".{s.inside}")) if s.inside else path
        fault = F.when(~_exactly(inner, s.members, s.flag), place)
        for member in (s.call_id, s.name):
            if member:
                fault = fault.when(_kind(_at(inner, member)) != "STRING", F.concat(place, F.lit(f".{member}")))
        text = _at(inner, s.text)
        wrong = {"STRING": _kind(text) != "STRING", "OBJECT": _kind(text) != "OBJECT", "JSON": _kind(F.try_parse_json(_string(text))) != "OBJECT", "ANY": F.lit(False)}
        fault = fault.when(wrong[s.text_kind], F.concat(place, F.lit(f".{s.text}")))
        if s.flag:
            fault = fault.when(~_kind(_at(inner, s.flag)).isin("", "BOOLEAN"), F.concat(place, F.lit(f".{s.flag}")))
        shown = F.coalesce(_string(text), F.to_json(text))
        good = _item(s.kind, _string(_at(inner, s.call_id)) if s.call_id else None, _string(_at(inner, s.name)) if s.name else None, shown)
        out = out.when(F.coalesce(s.meant, F.lit(False)), F.when(fault.isNotNull(), _item("refused", fault=fault)).otherwise(good))
    return out.otherwise(_item("refused", fault=path))


def _text_shape(v: Column, word: str | Column = "text") -> Shape:
    return Shape(_string(_at(v, "type")) == word, "text", ("type", "text"), "text")


def _blocks(v: Column, path: Column, shapes) -> Column:
    return F.transform(_list(v), lambda b, i: _block(b, F.concat(path, F.lit("["), i, F.lit("]")), shapes(b)))


def _texts(v: Column, path: Column, shapes) -> Column:
    """The items of a content that is one text or a list of blocks."""
    return F.when(_kind(v) == "STRING", F.array(_item("text", text=_string(v)))).when(_kind(v) == "ARRAY", _blocks(v, path, shapes)).otherwise(F.array(_item("refused", fault=path)))


def _turn(role, items: Column, fault: Column | None = None) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), items.alias("items"), (F.lit(None) if fault is None else fault).cast("string").alias("fault"))


def _refused(path: Column) -> Column:
    return _turn(F.lit(None).cast("string"), F.array().cast(f"array<{ITEM}>"), path)


def _answering(role: Column, items: Column, path: Column) -> Column:
    """A turn whose one item answers a call is the tool's; such an item beside others is refused."""
    answers = F.exists(items, lambda i: i["kind"] == "tool_result")
    alone = answers & (F.size(items) == 1)
    return F.when(alone, _turn("tool", items)).when(answers, _refused(path)).otherwise(_turn(role, items))


def _of_messages(v: Column, path: Column) -> Column:
    role = _string(_at(v, "role"))

    def shapes(b: Column) -> list[Shape]:
        kind = _string(_at(b, "type"))
        return [
            _text_shape(b),
            Shape((kind == "tool_use") & (role == "assistant"), "tool_call", ("type", "id", "name", "input"), "input", "OBJECT", "id", "name"),
            Shape((kind == "tool_result") & (role == "user"), "tool_result", ("type", "tool_use_id", "content"), "content", "ANY", "tool_use_id", flag="is_error"),
        ]

    items = _texts(_at(v, "content"), F.concat(path, F.lit(".content")), shapes)
    fits = (_kind(v) == "OBJECT") & _exactly(v, ("role", "content"))
    return F.when(~fits, _refused(path)).when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), _refused(F.concat(path, F.lit(".role")))).otherwise(_answering(role, items, path))


def _of_generate(v: Column, path: Column) -> Column:
    said = _string(_at(v, "role"))

    def shapes(p: Column) -> list[Shape]:
        only = lambda m: _exactly(p, (m,))
        return [
            Shape(only("text"), "text", ("text",), "text"),
            Shape(only("functionCall") & (said == "model"), "tool_call", ("id", "name", "args"), "args", "OBJECT", "id", "name", "functionCall"),
            Shape(only("functionResponse") & (said == "user"), "tool_result", ("id", "name", "response"), "response", "ANY", "id", "name", "functionResponse"),
        ]

    place = F.concat(path, F.lit(".parts"))
    parts = _at(v, "parts")
    items = F.when(_kind(parts) == "ARRAY", _blocks(parts, place, shapes)).otherwise(F.array(_item("refused", fault=place)))
    fits = (_kind(v) == "OBJECT") & _exactly(v, ("role", "parts"))
    role = F.when(said == "model", "assistant").otherwise(said)
    return F.when(~fits, _refused(path)).when(~F.coalesce(said.isin("user", "model"), F.lit(False)), _refused(F.concat(path, F.lit(".role")))).otherwise(_answering(role, items, path))


def _calls(v: Column, call_id: str, answer: Shape, text_kind: str) -> list[Shape]:
    return [Shape(_string(_at(v, "type")) == "function_call", "tool_call", ("type", call_id, "name", "arguments"), "arguments", text_kind, call_id, "name"), answer]


def _called(v: Column, path: Column, shapes: list[Shape]) -> Column:
    """The turn of a call or its answer, which are items of their own."""
    item = _block(v, path, shapes)
    return _turn(F.when(item["kind"] == "tool_call", "assistant").when(item["kind"] == "tool_result", "tool"), F.array(item))


def _of_responses(v: Column, path: Column) -> Column:
    kind, role = _string(_at(v, "type")), _string(_at(v, "role"))
    answer = Shape(kind == "function_call_output", "tool_result", ("type", "call_id", "output"), "output", "ANY", "call_id")
    word = F.when(role == "assistant", "output_text").otherwise("input_text")
    items = _texts(_at(v, "content"), F.concat(path, F.lit(".content")), lambda b: [_text_shape(b, word)])
    fits = _exactly(v, ("type", "role", "content"))
    message = F.when(~fits, _refused(path)).when(~F.coalesce(role.isin(*SAID), F.lit(False)), _refused(F.concat(path, F.lit(".role")))).otherwise(_turn(role, items))
    return F.when(kind == "message", message).otherwise(_called(v, path, _calls(v, "call_id", answer, "JSON")))


def _of_interactions(v: Column, path: Column) -> Column:
    kind = _string(_at(v, "type"))
    answer = Shape(kind == "function_result", "tool_result", ("type", "call_id", "name", "result"), "result", "ANY", "call_id", "name")
    role = F.when(kind == "user_input", STEPS["user_input"]).when(kind == "model_output", STEPS["model_output"])
    content, place = _at(v, "content"), F.concat(path, F.lit(".content"))
    items = F.when(_kind(content) == "ARRAY", _blocks(content, place, lambda b: [_text_shape(b)])).otherwise(F.array(_item("refused", fault=place)))
    step = F.when(~_exactly(v, ("type", "content")), _refused(path)).otherwise(_turn(role, items))
    return F.when(role.isNotNull(), step).otherwise(_called(v, path, _calls(v, "id", answer, "OBJECT")))


READERS = {"messages": _of_messages, "responses": _of_responses, "generate": _of_generate, "interactions": _of_interactions}


def _system(protocol: str, v: Column) -> Column:
    said, path = _at(v, SYSTEM[protocol]), F.lit(f"$.{SYSTEM[protocol]}")
    one = F.when(_kind(said) == "STRING", F.array(_item("text", text=_string(said)))).otherwise(F.array(_item("refused", fault=path)))
    if protocol == "messages":
        one = _texts(said, path, lambda b: [_text_shape(b)])
    if protocol == "generate":
        parts, place = _at(said, "parts"), F.lit("$.systemInstruction.parts")
        listed = F.when(_kind(parts) == "ARRAY", _blocks(parts, place, lambda p: [Shape(F.lit(True), "text", ("text",), "text")])).otherwise(F.array(_item("refused", fault=place)))
        one = F.when((_kind(said) == "OBJECT") & _exactly(said, ("parts",)), listed).otherwise(F.array(_item("refused", fault=path)))
    none = F.array().cast(f"array<{TURN}>")
    return F.when(_kind(said) == "", none).otherwise(F.array(_turn("system", one).cast(TURN)))


def content(bodies: DataFrame, protocol: str, key: str = "request_id", body: str = "body", extensions: tuple[str, ...] = ()) -> DataFrame:
    """``key``, message, item, role, classification, kind, call_id, name, text, error: a body's content, a row each.

    ``protocol`` is one of :data:`PROTOCOLS`. kind: text, tool_call (text: its arguments as
    JSON), tool_result or refused; ``error`` is the path of what was refused, and such a row has
    no text. A body that is no JSON object, has a member that neither the protocol nor ``extensions`` has or lacks
    a list of turns has one refused row for that. What stands for the system comes first. A turn
    without items has one row of nulls.
    """
    v, name = F.col("_v"), TURNS[protocol]
    listed, reader = _at(v, name), READERS[protocol]
    path = lambda i: F.concat(F.lit(f"$.{name}["), i, F.lit("]"))
    turns = F.transform(_list(listed), lambda t, i: F.when(_kind(t) == "OBJECT", reader(t, path(i)).cast(TURN)).otherwise(_refused(path(i)).cast(TURN)))
    if name == "input":
        turns = F.when(_kind(listed) == "STRING", F.array(_turn("user", F.array(_item("text", text=_string(listed)))).cast(TURN))).otherwise(turns)
    alien = F.try_element_at(F.array_sort(F.array_except(_members(v), F.array(*[F.lit(m) for m in MEMBERS[protocol] + extensions]))), F.lit(1))
    shape = _kind(listed).isin("ARRAY", "STRING") if name == "input" else _kind(listed) == "ARRAY"
    fault = F.when(_kind(v) != "OBJECT", "$").when(alien.isNotNull(), F.concat(F.lit("$."), alien)).when(~shape, f"$.{name}")
    alone = F.array(_refused(fault).cast(TURN))
    read = bodies.select(key, F.try_parse_json(body).alias("_v")).withColumn("_fault", fault)
    each = read.select(key, F.posexplode(F.when(F.col("_fault").isNotNull(), alone).otherwise(F.concat(_system(protocol, v), turns))).alias("message", "t"))
    items = F.when(F.col("t.fault").isNotNull(), F.array(_item("refused", fault=F.col("t.fault")))).otherwise(F.col("t.items"))
    rows = each.select(key, "message", F.col("t.role").alias("role"), F.posexplode_outer(items).alias("item", "i"))
    return rows.select(key, "message", "item", "role", F.when(F.col("role").isNotNull(), classification(F.col("role"))).alias("classification"), "i.kind", "i.call_id", "i.name", "i.text", F.col("i.fault").alias("error"))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"(?s)\A\[(.*)\]\z", "$1")


def _object(**members) -> Column:
    """A JSON object of members that are JSON already."""
    pieces = [F.concat(F.lit(f'"{n}":'), c if isinstance(c, Column) else F.lit(c)) for n, c in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def _array(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def bodies_of(rows: DataFrame, protocol: str, model: Column, key: str = "request_id", most_tokens: int = 1024) -> DataFrame:
    """``key``, body, error: a body of ``protocol`` for the rows of each request, as :func:`content` gives them.

    Texts of the system and of developers go to the place that the protocol has for them: they
    must come before all other turns, and be one turn where it holds one text (of two texts
    joined by a line end). A tool's turn is one answer. Rows with an error, calls outside the
    assistant's turns and what the protocol cannot hold give no body but the error ``$.turns[n]``
    of the first such turn. A body is one row.
    """
    said = F.array_sort(F.collect_list(F.struct("item", "kind", "call_id", "name", "text", "error")))
    each = rows.groupBy(key, "message").agg(F.first("role").alias("role"), said.alias("all"))
    role, every = F.col("role"), F.filter("all", lambda i: i["kind"].isNotNull())
    of = lambda kind: F.filter(every, lambda i: i["kind"] == kind)
    texts, calls, answers = of("text"), of("tool_call"), of("tool_result")
    system = F.coalesce(role.isin("system", "developer"), F.lit(False))
    value = lambda t: F.when(F.try_parse_json(t).isNotNull(), t).otherwise(_quoted(t))
    typed = lambda word: (lambda i: _object(type=F.concat(F.lit('"'), word, F.lit('"')), text=_quoted(i["text"])))
    plain_text = typed(F.lit("text"))
    if protocol == "messages":
        block = lambda i: F.when(i["kind"] == "text", plain_text(i)).when(i["kind"] == "tool_call", _object(type='"tool_use"', id=_quoted(i["call_id"]), name=_quoted(i["name"]), input=i["text"])).otherwise(_object(type='"tool_result"', tool_use_id=_quoted(i["call_id"]), content=_quoted(i["text"])))
        written = _object(role=_quoted(F.when(role == "tool", "user").otherwise(role)), content=_array(F.transform(every, block)))
        spoken = F.array_join(F.transform(texts, plain_text), ",")
    elif protocol == "generate":
        part = lambda i: F.when(i["kind"] == "text", _object(text=_quoted(i["text"]))).when(i["kind"] == "tool_call", _object(functionCall=_object(id=_quoted(i["call_id"]), name=_quoted(i["name"]), args=i["text"]))).otherwise(_object(functionResponse=_object(id=_quoted(i["call_id"]), name=_quoted(i["name"]), response=value(i["text"]))))
        written = _object(role=F.when(role == "assistant", '"model"').otherwise('"user"'), parts=_array(F.transform(every, part)))
        spoken = F.array_join(F.transform(texts, lambda i: _object(text=_quoted(i["text"]))), ",")
    else:
        if protocol == "responses":
            block = typed(F.when(role == "assistant", "output_text").otherwise("input_text"))
            message = _object(type='"message"', role=_quoted(role), content=_array(F.transform(texts, block)))
            call = lambda i: _object(type='"function_call"', call_id=_quoted(i["call_id"]), name=_quoted(i["name"]), arguments=_quoted(i["text"]))
            answer = lambda i: _object(type='"function_call_output"', call_id=_quoted(i["call_id"]), output=_quoted(i["text"]))
        else:
            message = _object(type=F.when(role == "assistant", '"model_output"').otherwise('"user_input"'), content=_array(F.transform(texts, plain_text)))
            call = lambda i: _object(type='"function_call"', id=_quoted(i["call_id"]), name=_quoted(i["name"]), arguments=i["text"])
            answer = lambda i: _object(type='"function_result"', call_id=_quoted(i["call_id"]), name=_quoted(i["name"]), result=value(i["text"]))
        first = F.when(F.size(texts) > 0, F.array(message)).otherwise(F.array().cast("array<string>"))
        written = F.array_join(F.concat(first, F.transform(calls, call), F.transform(answers, answer)), ",")
        spoken = F.array_join(F.transform(texts, lambda i: i["text"]), "\n")
    wrong = F.exists("all", lambda i: i["error"].isNotNull()) | role.isNull() | ~F.coalesce(role.isin(*SAID, "tool"), F.lit(False))
    wrong = wrong | F.exists(every, lambda i: ~i["kind"].isin("text", "tool_call", "tool_result")) | ((F.size(calls) > 0) & (role != "assistant")) | ((F.size(answers) > 0) != (role == "tool")) | ((role == "tool") & (F.size(every) != 1))
    made = each.select(key, "message", system.alias("system"), F.when(system, spoken).otherwise(written).alias("w"), F.coalesce(wrong, F.lit(True)).alias("wrong"))
    whole = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("message", "system", "w", "wrong"))).alias("turns"))
    turns = F.col("turns")
    ahead = lambda i: F.slice(turns, F.lit(1), i)
    if protocol in ("messages", "generate"):
        late = lambda t, i: t["system"] & F.exists(ahead(i), lambda u: ~u["system"])
    elif protocol == "responses":
        late = lambda t, i: t["system"] & F.exists(ahead(i), lambda u: u["system"])
    else:
        late = lambda t, i: t["system"] & (i > 0)
    faults = F.filter(F.transform(turns, lambda t, i: F.when(t["wrong"] | late(t, i), F.concat(F.lit("$.turns["), i, F.lit("]")))), lambda e: e.isNotNull())
    error = F.try_element_at(faults, F.lit(1))
    of_system = F.filter(turns, lambda t: t["system"])
    told = F.transform(of_system, lambda t: t["w"])
    others = _array(F.transform(F.filter(turns, lambda t: ~t["system"] & (t["w"] != "")), lambda t: t["w"]))
    holder = {"messages": _array(told), "generate": _object(parts=_array(told))}.get(protocol, _quoted(F.array_join(told, "\n")))
    named = F.when(F.size(of_system) > 0, F.concat(F.lit(f'"{SYSTEM[protocol]}":'), holder))
    limit = F.lit(f'"max_tokens":{most_tokens}') if protocol == "messages" else F.lit(None).cast("string")
    body = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"model":'), _quoted(model)), limit, named, F.concat(F.lit(f'"{TURNS[protocol]}":'), others)), F.lit("}"))
    return whole.withColumn("error", error).select(key, F.when(F.col("error").isNull(), body).alias("body"), "error")
