"""Settings and tools of requests: read with the path of what is of a wrong kind, and gates for what is not allowed.

As elsewhere for bodies, all is expressions on variants: a row a body, a row a tool, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .turns import MEMBERS, _at, _exactly, _kind, _list, _members, _quoted, _string

# Where a protocol has its settings, and the members of a tool.
PLACES = {
    "messages": ("", {"max_tokens": "max_tokens", "temperature": "temperature", "top_p": "top_p", "stop": "stop_sequences"}),
    "responses": ("", {"max_tokens": "max_output_tokens", "temperature": "temperature", "top_p": "top_p"}),
    "generate": ("generationConfig", {"max_tokens": "maxOutputTokens", "temperature": "temperature", "top_p": "topP", "stop": "stopSequences"}),
    "interactions": ("generation_config", {"max_tokens": "max_output_tokens", "temperature": "temperature", "top_p": "top_p", "stop": "stop_sequences"}),
}
FORMATS = {"generate": ("responseMimeType", "responseSchema")}
STORING = ("responses", "interactions")
TOOLS = {
    "messages": ("name", "description", "input_schema", "strict"),
    "responses": ("type", "name", "description", "parameters", "strict"),
    "generate": ("name", "description", "parameters"),
    "interactions": ("type", "name", "description", "parameters"),
}
STRICT_UNLESS_SAID = ("responses",)
# Fixed values end.


def settings(bodies: DataFrame, protocol: str, key: str = "request_id", body: str = "body", storage: bool = False, extensions: tuple[str, ...] = ()) -> DataFrame:
    """``key``, model, max_tokens, temperature, top_p, stop, stream, store, extensions, error: a row a body.

    ``error`` is the path of the first of: a body that is no object, a member that the protocol
    does not have and that is not one of ``extensions``, a model that is no text, a setting of a
    wrong kind or an unknown one, a stream or store that is no boolean, a wish to store where
    ``storage`` is false. All else is null then. Nulls count as not given; a stop may be one
    text or a list of them. ``extensions`` are those that a body has, as a JSON object, or null.
    """
    v = F.col("_v")
    inside, names = PLACES[protocol]
    held = _at(v, inside) if inside else v
    place = f"$.{inside}." if inside else "$."
    alien = lambda c, known: F.try_element_at(F.array_sort(F.array_except(_members(c), F.array(*[F.lit(k) for k in known]))), F.lit(1))
    unknown = alien(v, MEMBERS[protocol] + extensions)
    error = F.when(_kind(v) != "OBJECT", "$").when(unknown.isNotNull(), F.concat(F.lit("$."), unknown)).when(_kind(_at(v, "model")) != "STRING", "$.model")
    if inside:
        inner = alien(held, (*names.values(), *FORMATS.get(protocol, ())))
        error = error.when(~_kind(held).isin("", "OBJECT"), f"$.{inside}").when(inner.isNotNull(), F.concat(F.lit(place), inner))
    none, number = ("", "VOID"), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    got = {n: _at(held, names[n]) for n in names}
    for n in ("max_tokens", "temperature", "top_p"):
        error = error.when(~_kind(got[n]).isin(*none, *(("BIGINT",) if n == "max_tokens" else number)), place + names[n])
    if "stop" in names:
        bad = F.exists(_list(got["stop"]), lambda s: _kind(s) != "STRING")
        error = error.when(~_kind(got["stop"]).isin(*none, "STRING", "ARRAY") | bad, place + names["stop"])
        stop = F.when(_kind(got["stop"]) == "STRING", F.array(_string(got["stop"]))).otherwise(F.transform(_list(got["stop"]), _string))
    else:
        stop = F.array().cast("array<string>")
    stream, store = _at(v, "stream"), _at(v, "store")
    flag = lambda c: F.coalesce(F.when(_kind(c) == "BOOLEAN", F.try_variant_get(c, "$", "boolean")), F.lit(False))
    error = error.when(~_kind(stream).isin("", "BOOLEAN"), "$.stream")
    if protocol in STORING:
        error = error.when(~_kind(store).isin(*none, "BOOLEAN"), "$.store")
        if not storage:
            error = error.when(flag(store), "$.store")
    extra = [F.when(_kind(_at(v, e)) != "", F.concat(_quoted(F.lit(e)), F.lit(":"), F.to_json(_at(v, e)))) for e in sorted(extensions)]
    more = F.concat(F.lit("{"), F.concat_ws(",", *extra), F.lit("}")) if extra else F.lit("{}")
    values = {
        "model": _string(_at(v, "model")), "max_tokens": F.try_variant_get(got["max_tokens"], "$", "long"), "temperature": F.try_variant_get(got["temperature"], "$", "double"), "top_p": F.try_variant_get(got["top_p"], "$", "double"),
        "stop": stop, "stream": flag(stream), "store": flag(store) if protocol in STORING else F.lit(False), "extensions": F.nullif(more, F.lit("{}")),
    }
    read = bodies.select(key, F.try_parse_json(body).alias("_v")).withColumn("error", error)
    return read.select(key, *[F.when(F.col("error").isNull(), c).alias(n) for n, c in values.items()], "error")


def tools(bodies: DataFrame, protocol: str, key: str = "request_id", body: str = "body", remote: bool = False) -> DataFrame:
    """``key``, tool, name, description, schema, strict, remote, error: a body's tools, a row each, in order.

    A tool that the provider runs itself has its whole configuration as ``remote``, if ``remote`` is
    allowed, else an error. ``error`` is the path of what is unknown or of a wrong kind; all else is null then.
    Tools that are no list have one row of that error; bodies without tools have no rows.
    """
    listed = _at(F.col("_v"), "tools")
    named = TOOLS[protocol]
    schema_name = next(m for m in named if m in ("input_schema", "parameters"))
    row = lambda name=None, description=None, schema=None, strict=None, ran=None, error=None: F.struct(
        *[(c if isinstance(c, Column) else F.lit(c)).cast(t).alias(n) for n, c, t in (("name", name, "string"), ("description", description, "string"), ("schema", schema, "string"), ("strict", strict, "boolean"), ("remote", ran, "string"), ("error", error, "string"))]
    )

    def defined(t: Column, path: Column) -> Column:
        under = lambda m: F.concat(path, F.lit(f".{m}"))
        text, strict, schema = _at(t, "description"), _at(t, "strict"), _at(t, schema_name)
        known = _exactly(t, named) if protocol == "generate" else F.size(F.array_except(_members(t), F.array(*[F.lit(m) for m in named]))) == 0
        fault = F.when((_kind(t) != "OBJECT") | ~known, path).when(_kind(_at(t, "name")) != "STRING", under("name")).when(~_kind(text).isin("", "STRING"), under("description")).when(_kind(schema) != "OBJECT", under(schema_name))
        if "strict" in named:
            fault = fault.when(~_kind(strict).isin("", "BOOLEAN"), under("strict"))
        asked = F.coalesce(F.when(_kind(strict) == "BOOLEAN", F.try_variant_get(strict, "$", "boolean")), F.lit(protocol in STRICT_UNLESS_SAID)) if "strict" in named else F.lit(False)
        return F.when(fault.isNotNull(), row(error=fault)).otherwise(row(_string(_at(t, "name")), F.coalesce(_string(text), F.lit("")), F.to_json(schema), asked))

    def one(t: Column, i: Column) -> Column:
        path = F.concat(F.lit("$.tools["), i, F.lit("]"))
        away = row(ran=F.to_json(t)) if remote else row(error=path)
        if protocol == "generate":
            inner, place = _at(t, "functionDeclarations"), F.concat(path, F.lit(".functionDeclarations"))
            several = F.transform(_list(inner), lambda d, j: defined(d, F.concat(place, F.lit("["), j, F.lit("]"))))
            own = F.when(_kind(inner) == "ARRAY", several).otherwise(F.array(row(error=place)))
            return F.when(_kind(t) != "OBJECT", F.array(row(error=path))).when(_exactly(t, ("functionDeclarations",)), own).otherwise(F.array(away))
        ran = _kind(_at(t, "type")) != "" if protocol == "messages" else F.coalesce(_string(_at(t, "type")) != "function", F.lit(True))
        return F.array(F.when(_kind(t) != "OBJECT", row(error=path)).when(ran, away).otherwise(defined(t, path)))

    every = F.when(_kind(listed) == "ARRAY", F.flatten(F.transform(_list(listed), one))).when(_kind(listed) != "", F.array(row(error="$.tools")))
    return bodies.select(key, F.try_parse_json(body).alias("_v")).select(key, F.posexplode(every).alias("tool", "t")).select(key, "tool", "t.*")
