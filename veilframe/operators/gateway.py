"""Checks and projections of requests and answers at the border, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of parts that need local redaction, and grammars.
IMAGE_PARTS = ("image", "image_url", "input_image", "screen", "screenshot")
CONVERSATION_ID = r"\A[A-Za-z0-9_-]{8,128}\z"
SAFE_EVENT = r"\A[a-z][a-z0-9_]{0,63}\z"
SUPPRESSED = "log_suppressed"
LOG_HEAD = ("timestamp", "level", "logger")
LOG_FIELDS = ("request_id", "model_length", "masking_mode", "detected_entities_count", "detected_entity_types", "policy_result", "latency_ms", "status_code", "error_type")
# Fixed values end.


def limit_identity(authorization: Column, client: Column) -> Column:
    """Who a request counts for: ``token:`` and the SHA-256 of its secret, else ``client:`` and its host.

    Null and empty are no header, and no host (``unknown``).
    """
    secret = F.when(authorization.rlike(r"(?is)\Abearer ."), F.substring(authorization, 8, F.length(authorization))).otherwise(authorization)
    host = F.coalesce(F.nullif(client, F.lit("")), F.lit("unknown"))
    return F.when(F.coalesce(authorization != "", F.lit(False)), F.concat(F.lit("token:"), F.sha2(secret, 256))).otherwise(F.concat(F.lit("client:"), host))


def safe_stem(filename: Column, fallback: str = "file") -> Column:
    """A file name's stem in at most 60 ASCII letters, digits, ``-`` and ``_``; ``fallback`` if nothing is left."""
    path = F.regexp_replace(F.translate(F.coalesce(filename, F.lit("")), "\\", "/"), r"(?:/|(?<=/)\.(?=/|\z))+\z", "")
    base = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]+\z", "")
    kept = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_-]", ""), 1, 60)
    return F.when(kept == "", fallback).otherwise(kept)


def conversation_id(value: Column) -> Column:
    """struct<id, error>: an id of 8 to 128 letters, digits, ``_`` and ``-``; null and empty are none, without error."""
    given = F.nullif(value, F.lit(""))
    ok = given.rlike(CONVERSATION_ID)
    return F.struct(F.when(ok, given).alias("id"), F.when(~ok, "conversation id").alias("error"))


def too_large(body: Column, most: int, declared: Column | None = None) -> Column:
    """Whether a body, by its declared or its true size in bytes, is over ``most`` (a null body has none)."""
    true = F.coalesce(F.octet_length(body) > most, F.lit(False))
    return true if declared is None else true | F.coalesce(declared > most, F.lit(False))


def unknown_keys(body: Column, allowed: tuple[str, ...]) -> Column:
    """Sorted keys of a JSON object that are not ``allowed``; null for anything else."""
    return F.array_sort(F.array_except(F.json_object_keys(body), F.array(*map(F.lit, allowed))))


def model_name(model: Column) -> Column:
    """A model's name without the ``models/`` before it, cut for logs to 256 characters."""
    return F.substring(F.regexp_replace(model, r"\Amodels/", ""), 1, 256)


def instruction(replacements: Column) -> Column:
    """What tells a model to keep tokens as they are; null if there are none."""
    used = F.array_distinct(F.filter(replacements, lambda r: r.isNotNull() & (r != "")))
    said = F.concat(F.lit("Some values of this conversation are replaced by tokens: "), F.array_join(used, ", "), F.lit(". Where you mean such a value, write its token letter by letter; never guess what it stands for."))
    return F.when(F.size(used) > 0, said)


def _kind(value: Column) -> Column:
    """A JSON value's kind: OBJECT, ARRAY, STRING, VOID (null), ...; null if it is absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _given(value: Column) -> Column:
    return value.isNotNull() & (_kind(value) != "VOID")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(_kind(value) == kind, F.lit(False))


def unsafe_media(body: Column) -> Column:
    """The kind, in lower case, of the first message part that holds an image or screen; null if none does."""
    messages = _at(F.try_parse_json(body), "$.messages", "array<variant>")

    def parts(m: Column) -> Column:
        content = F.when(_is(m, "OBJECT"), _at(m, "$.content"))
        return F.when(_is(content, "ARRAY"), F.try_variant_get(content, "$", "array<variant>")).otherwise(F.array(content))

    kinds = F.transform(F.flatten(F.transform(messages, parts)), lambda p: F.lower(F.when(_is(p, "OBJECT"), _at(p, "$.type", "string"))))
    return F.try_element_at(F.filter(kinds, lambda k: F.coalesce(k.isin(*IMAGE_PARTS), F.lit(False))), F.lit(1))


def response_error(body: Column) -> Column:
    """What is wrong with a successful chat answer, as ``path: message``; null if nothing is.

    The first fault counts, in order of choices and, within one, of the checks below.
    """
    root = F.try_parse_json(body)
    listed = _at(root, "$.choices")
    choices = _at(root, "$.choices", "array<variant>")
    each = F.filter(F.transform(choices, lambda c, i: _choice_error(c, F.concat(F.lit("$.choices["), i.cast("string"), F.lit("]")))), lambda e: e.isNotNull())
    return (
        F.when(~_is(root, "OBJECT"), "$: no object")
        .when(~_is(listed, "ARRAY"), "$.choices: no list")
        .when(F.size(choices) == 0, "$.choices: empty")
        .otherwise(F.try_element_at(each, F.lit(1)))
    )


def _choice_error(choice: Column, path: Column) -> Column:
    message = _at(choice, "$.message")
    content, refusal, call, tools = (_at(message, f"$.{k}") for k in ("content", "refusal", "function_call", "tool_calls"))
    under = lambda more, said: F.concat(path, F.lit(f".message{more}: {said}"))
    tool_list = F.try_variant_get(tools, "$", "array<variant>")

    def tool_error(tool: Column, i: Column) -> Column:
        at = F.concat(path, F.lit(".message.tool_calls["), i.cast("string"), F.lit("]"))
        good = F.coalesce(_at(tool, "$.type", "string") == "function", F.lit(False)) & _is(_at(tool, "$.id"), "STRING")
        return F.when(~_is(tool, "OBJECT"), F.concat(at, F.lit(": no object"))).when(~good, F.concat(at, F.lit(": no function call"))).otherwise(_function_error(_at(tool, "$.function"), F.concat(at, F.lit(".function"))))

    tool_errors = F.filter(F.transform(tool_list, tool_error), lambda e: e.isNotNull())
    nothing = ~(_given(content) | _given(tools) | _given(call) | _given(refusal))
    role = F.when(_is(_at(message, "$.role"), "STRING"), _at(message, "$.role", "string"))
    wrong_call = F.when(_given(call), _function_error(call, F.concat(path, F.lit(".message.function_call"))))
    return (
        F.when(~_is(choice, "OBJECT"), F.concat(path, F.lit(": no object")))
        .when(~_is(message, "OBJECT"), under("", "no object"))
        .when(F.coalesce(role != "assistant", F.lit(True)), under(".role", "not the assistant"))
        .when(_given(content) & ~_is(content, "STRING") & ~_is(content, "ARRAY"), under(".content", "neither text nor list"))
        .when(F.coalesce(nothing, F.lit(True)), under("", "says nothing"))
        .when(_given(refusal) & ~_is(refusal, "STRING"), under(".refusal", "no text"))
        .when(wrong_call.isNotNull(), wrong_call)
        .when(_given(tools) & ~_is(tools, "ARRAY"), under(".tool_calls", "no list"))
        .otherwise(F.try_element_at(tool_errors, F.lit(1)))
    )


def _function_error(function: Column, path: Column) -> Column:
    good = _is(_at(function, "$.name"), "STRING") & _is(_at(function, "$.arguments"), "STRING")
    return F.when(~_is(function, "OBJECT"), F.concat(path, F.lit(": no object"))).when(~good, F.concat(path, F.lit(": name or arguments no text")))


def bearer_secret(authorization: Column) -> Column:
    """The secret of a bearer header, whose scheme may be in either case; null for any other header."""
    return F.nullif(F.regexp_extract(authorization, r"(?is)\Abearer (.+)\z", 1), F.lit(""))


def admitted(requests: DataFrame, keys: DataFrame, header: str = "authorization") -> DataFrame:
    """``requests`` plus ``admitted``: whether its bearer secret is one of ``keys`` (a column ``key``).

    Secrets and keys meet by their SHA-256, so that none is shuffled or shown.
    """
    known = keys.where("key <> ''").select(F.sha2("key", 256).alias("_key")).distinct().withColumn("_known", F.lit(True))
    asked = requests.withColumn("_asked", F.sha2(bearer_secret(F.col(header)), 256))
    return asked.join(known, F.col("_asked") == F.col("_key"), "left").withColumn("admitted", F.coalesce("_known", F.lit(False))).drop("_asked", "_key", "_known")


def log_line(df: DataFrame, message: str = "message") -> Column:
    """A log row as JSON: level, logger, the message if it is an event's name, and those of the columns that may be shown.

    Null members are left out.
    """
    event = F.col(message).rlike(SAFE_EVENT)
    shown = [F.col(c) for c in (*LOG_HEAD, *LOG_FIELDS) if c in df.columns]
    return F.to_json(F.struct(F.when(event, F.col(message)).otherwise(SUPPRESSED).alias("message"), *shown))


def approved(replacements: Column, allowlisted: Column, token: str) -> Column:
    """struct<tokens, values>: of a request's replacements the tokens, and the others with what is allowlisted; null arrays are empty."""
    none = F.array().cast("array<string>")
    given = F.array_distinct(F.array_compact(F.coalesce(replacements, none)))
    is_token = lambda r: r.rlike(rf"\A(?:{token})\z")
    return F.struct(F.filter(given, is_token).alias("tokens"), F.array_union(F.filter(given, lambda r: ~is_token(r)), F.coalesce(allowlisted, none)).alias("values"))
