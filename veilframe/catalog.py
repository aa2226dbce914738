"""The catalogue of registered queries, and the same results in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapter_catalog
from .functions import validators
from .operators import bodies, conversations, detect, docx, evaluation, gateway, mask, metrics, plain, policy, ratelimit, risk, sse, transform, wire
from .plans.intermediate import cut, dealt, streamed
from .streaming import guard as stream_guards
from .streaming import restore as stream
from .streaming import store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return dealt(_read(spark, sf_dir, name))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(_texts(spark, sf_dir).select("doc_id", "lang", "text"))
    return found.withColumn("risk", risk.assess(F.col("detections")))


def risk_bucket_by_lang(spark, sf_dir):
    return _assessed(spark, sf_dir).groupBy("lang", F.col("risk.bucket").alias("bucket")).agg(F.count("*").alias("n"), F.sum("risk.score").alias("total_score"))


def risk_score(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", F.col("risk.score").cast("long").alias("score"), F.col("risk.bucket").alias("bucket"), F.array_join("risk.signals", ",").alias("signals"))


def _found(df: DataFrame, key: str) -> DataFrame:
    # Of a plain explode Spark infers a filter and pushes it into detection, which is then worked out many times over.
    return df.select(F.col(key), F.explode_outer("detections").alias("d")).where("d is not null").select(key, "d.entity_type", F.col("d.start").cast("long").alias("start"), F.col("d.end").cast("long").alias("end"), "d.confidence", "d.recognizer", "d.state")


def detect_documents(spark, sf_dir):
    return _found(detect.detect(_texts(spark, sf_dir).select("doc_id", "text")), "doc_id")


def detect_pages(spark, sf_dir):
    return _found(detect.detect(_texts(spark, sf_dir, "pages").select("page_id", "html"), "html"), "page_id")


def _masked(spark, sf_dir, mode):
    found = detect.detect(_texts(spark, sf_dir).select(F.col("doc_id").alias("scope_id"), "text"))
    return mask.mask(found, mode, key="demo")


def mask_semantic(spark, sf_dir):
    return _masked(spark, sf_dir, "semantic_placeholder")[0].select("scope_id", "masked")


def mask_redact(spark, sf_dir):
    return _masked(spark, sf_dir, "redact")[0].select("scope_id", "masked")


def mask_surrogate(spark, sf_dir):
    return _masked(spark, sf_dir, "surrogate")[0].select("scope_id", "masked")


def rehydrate_roundtrip(spark, sf_dir):
    rows, table = _masked(spark, sf_dir, "placeholder")
    return mask.restore(rows, table).select(F.col("scope_id").alias("doc_id"), F.col("restored").alias("text"))


def validate_numbers(spark, sf_dir):
    base = F.col("o_orderkey").cast("string")
    card = F.concat(F.lit("4"), F.lpad(F.reverse(base), 15, "0"))
    made = _read(spark, sf_dir, "orders").select("o_orderkey", card.alias("card"), F.lpad(base, 10, "0").alias("inn"), F.lpad(base, 11, "0").alias("snils"))
    return made.select("o_orderkey", validators.luhn(F.col("card")).alias("luhn"), validators.inn(F.col("inn")).alias("inn"), validators.snils(F.col("snils")).alias("snils"))


EVENT_POLICY = policy.Policy(
    (
        policy.Rule("large", 90, "REQUIRE_REVIEW", min_confidence=90.0),
        policy.Rule("purchase", 80, "TOKENIZE", {"event_type": ("purchase",)}),
        policy.Rule("view", 70, "ALLOW", {"event_type": ("view", "click")}, max_confidence=50.0),
    )
)


def policy_first_match(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("confidence"), (F.col("user_id") % 10 == 0).alias("public"))
    return policy.decide(events, EVENT_POLICY, F.col("public")).select("event_id", "action", "rule_id")


def policy_asserted(spark, sf_dir):
    """Customers' names, of which the even ones are asserted public for some tenants, providers and jurisdictions."""
    customers = _read(spark, sf_dir, "customer")
    words = lambda *w: F.array(*map(F.lit, w))
    none = F.array().cast("array<string>")
    scope = F.struct(
        words("BUILDING", "MACHINERY").alias("tenants"), words("chat").alias("applications"), words("request").alias("directions"), words("p0", "p1").alias("providers"),
        words("support").alias("purposes"), none.alias("routes"), none.alias("models"), F.when(F.col("c_custkey") % 4 == 0, none).otherwise(words("n1", "n2", "n3")).alias("jurisdictions"),
    )
    until = F.when(F.col("c_custkey") % 10 == 0, "2000-01-01 00:00:00").otherwise("2999-01-01 00:00:00").cast("timestamp")
    person = F.lit("PERSON")
    assertions = customers.where("c_custkey % 2 = 0").select(person.alias("entity_type"), policy.digest(person, F.col("c_name")).alias("value_sha256"), scope.alias("scope"), until.alias("expires_at"))
    context = customers.select(
        "c_custkey", person.alias("entity_type"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("tenant"), F.lit("chat").alias("application"), F.lit("request").alias("direction"),
        F.concat(F.lit("p"), F.col("c_nationkey") % 3).alias("provider"), F.lit("support").alias("purpose"), F.lit("r").alias("route"), F.lit("m").alias("model"), F.concat(F.lit("n"), "c_nationkey").alias("jurisdiction"),
    )
    rules = policy.Policy((policy.Rule("person", 10, "TOKENIZE", {"entity_type": ("PERSON",)}),))
    return policy.decide(policy.asserted(context, assertions), rules, F.col("public")).select("c_custkey", "action", "rule_id")


def public_digest(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", policy.digest(F.lit("PERSON"), F.col("c_name")).alias("sha"))


def principal_namespace(spark, sf_dir):
    made = _read(spark, sf_dir, "customer").select("c_custkey", metrics.principal(F.concat(F.lit("Bearer "), "c_name")).alias("p"))
    return made.select("c_custkey", "p.tenant_id", "p.subject_id", "p.method")


def conversation_trim_count(spark, sf_dir):
    return conversations.trim_by_count(_read(spark, sf_dir, "conversations"), 4)


def conversation_trim_chars(spark, sf_dir):
    return conversations.trim_by_chars(_read(spark, sf_dir, "conversations"), 400)


def turn_count(spark, sf_dir):
    return conversations.turn_counts(_read(spark, sf_dir, "conversations"))


def stream_reassemble(spark, sf_dir):
    return conversations.reassemble(conversations.fragments(_read(spark, sf_dir, "conversations")))


def metrics_counts(spark, sf_dir):
    return metrics.counters(_read(spark, sf_dir, "events"), "event_type", "event_id", 3)


def latency_summary(spark, sf_dir):
    return metrics.latency(_read(spark, sf_dir, "events"), "event_type", "value")


def p95_nearest_rank(spark, sf_dir):
    return metrics.nearest_rank(_read(spark, sf_dir, "events"), "event_type", "value")


def sse_frames(spark, sf_dir):
    said = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("data"))
    return sse.frames(sse.emit(said))


def rate_limit(spark, sf_dir):
    return ratelimit.limited(_read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("identity"), "ts"), 3, 3600)


def vault_budget(spark, sf_dir):
    made = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("original"))
    return mask.over_budget(made, "pos", 40, 1024)


def vault_collisions(spark, sf_dir):
    made = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope_id"), F.col("c_mktsegment").alias("replacement"), F.col("c_name").alias("original"), F.lit(True).alias("restore"))
    return mask.collisions(made)


def wire_numbers(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    made = _read(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("props").alias("body"), F.lit("custom").alias("provider"), none.alias("tokens"), none.alias("values"))
    return wire.violations(made)


def wire_check(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"), F.lit(64).alias("max_tokens")))
    made = _texts(spark, sf_dir).select(F.col("doc_id").alias("request_id"), body.alias("body"), F.lit("custom").alias("provider"), none.alias("tokens"), none.alias("values"))
    return wire.violations(made)


def output_guard(spark, sf_dir):
    """Documents as a provider's answers to their own masked text: all that was masked comes back."""
    found = detect.detect(_texts(spark, sf_dir).select(F.col("doc_id").alias("scope_id"), "text"))
    rows, table = mask.mask_all(found, key="demo")
    return wire.guard_text(mask.scope_pairs(rows, table), "masked").select(F.col("scope_id").alias("doc_id"), "guarded")


def _letters(spark, sf_dir):
    """A letter for each customer that holds an address, a phone number and a card number."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Mail user"), key, F.lit("@example.com, call +7 495 "), F.lpad(key, 7, "0"), F.lit(", card 4111 1111 1111 1111 for "), key, F.lit("."))
    return _texts(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("scope_id"), F.col("c_mktsegment").alias("tenant"), text.alias("text"))


def detect_letters(spark, sf_dir):
    return _found(detect.detect(_letters(spark, sf_dir)), "c_custkey").select("c_custkey", "entity_type", "start", "end", "confidence", "state")


LETTER_POLICY = policy.Policy(
    (
        policy.Rule("cards of machinery", 90, "BLOCK", {"entity_type": ("CARD_NUMBER",), "tenant": ("MACHINERY",)}),
        policy.Rule("phones", 80, "SURROGATE", {"entity_type": ("PHONE",)}, min_risk_score=50),
        policy.Rule("open addresses", 70, "ALLOW", {"entity_type": ("EMAIL",), "tenant": ("BUILDING",)}),
        policy.Rule("addresses", 60, "REDACT", {"entity_type": ("EMAIL",), "risk_bucket": ("CRITICAL",)}),
        policy.Rule("cards", 50, "TOKENIZE", {"entity_type": ("CARD_NUMBER",)}, min_confidence=0.9),
    )
)


def transform_actions(spark, sf_dir):
    """Letters under a policy that differs by tenant; a nation's customers share a vault."""
    rows, _ = transform.transform(_letters(spark, sf_dir), LETTER_POLICY, order="c_custkey", opaque=False)
    return rows.select("c_custkey", "masked", "error", F.array_join("blocked", ",").alias("blocked"))


def restore_letters(spark, sf_dir):
    """The same letters, with what may be restored restored within its scope."""
    rows, table = transform.transform(_letters(spark, sf_dir), LETTER_POLICY, order="c_custkey", opaque=False)
    return mask.restore(rows, table).select("c_custkey", "restored")


APPROVED, FOREIGN = "<MG:" + "A" * 26 + ">", "<MG:" + "B" * 26 + ">"


def guard_answers(spark, sf_dir):
    """An answer for each order with an approved token, a foreign one and an address of its own making."""
    key = F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("order "), key, F.lit(f" for {APPROVED}, not {FOREIGN}, cc who@other.example"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"), F.concat(F.lit(f"ref {APPROVED} "), key).alias("note")))
    pairs = F.array(F.struct(F.lit(APPROVED).alias("replacement"), F.concat(F.lit("user"), key, F.lit("@example.com")).alias("original")))
    made = _texts(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), body.alias("body"), pairs.alias("pairs"))
    return wire.guard_bodies(made).select("request_id", "rewritten")


def mask_bodies(spark, sf_dir):
    """A body for each customer with addresses as member names, and every tenth with one where the protocol allows none."""
    key = F.col("c_custkey").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    model = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("user"), key, F.lit("@example.com"))).otherwise("m-1")
    said = F.concat(F.lit("from user"), key, F.lit("@example.com to "), F.col("c_mktsegment"))
    body = F.concat(F.lit('{ "model": '), quoted(model), F.lit(', "input": '), quoted(said), F.lit(', "user'), key, F.lit('@example.com": '), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit(', "alt'), key, F.lit('@example.com": {"s": '), quoted(F.col("c_mktsegment")), F.lit("}}"))
    made = _texts(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("scope_id"), body.alias("body"))
    return bodies.mask_bodies(made, "redact")[0].select("request_id", "rewritten")


def sealed_props(spark, sf_dir):
    """The properties of events as bodies: what may go out, byte by byte."""
    made = _texts(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("props").alias("body"), F.lit("custom").alias("provider"), F.lit(None).cast("array<string>").alias("tokens"), F.lit(None).cast("array<string>").alias("values"))
    return wire.sealed(made)


def _notes(spark, sf_dir):
    """A note for each customer with an address, mostly a phone number, and in one segment a card number."""
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    phone = F.when(segment != "BUILDING", F.concat(F.lit(", call +7 495 "), F.lpad(key, 7, "0"))).otherwise("")
    card = F.when(segment == "MACHINERY", ", card 4111 1111 1111 1111").otherwise("")
    return _texts(spark, sf_dir, "customer").select("c_custkey", segment, F.concat(F.lit("Mail user"), key, F.lit("@example.com"), phone, card, F.lit(".")).alias("text"))


def plain_notes(spark, sf_dir):
    found = plain.detect(_notes(spark, sf_dir))
    return found.select("c_custkey", F.explode(plain.entities(F.col("detections"))).alias("e")).select("c_custkey", "e.type", "e.text", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), "e.method")


def plain_verdict(spark, sf_dir):
    rules = plain.actions([{"entity_type": "phone", "action": "redact"}, {"entity_type": "EMAIL", "action": "drop"}])
    found = plain.detect(_notes(spark, sf_dir)).withColumn("v", plain.verdict(F.col("detections"), rules))
    return found.select("c_custkey", "v.action", F.array_join("v.blocked", ",").alias("blocked"))


def strike_notes(spark, sf_dir):
    """Notes struck out; some addresses are public, and cards are blocked."""
    rules = plain.actions([], public={"emails": ["USER1@example.com", " user8@example.com"]})
    out = plain.strike(_notes(spark, sf_dir), rules)
    return out.select("c_custkey", "struck", F.col("redactions").cast("long").alias("redactions"), F.array_join("entity_types", ",").alias("entity_types"), F.array_join("blocked", ",").alias("blocked"))


def evaluate_notes(spark, sf_dir):
    """Notes as cases: phones of one segment are not expected, and one segment expects a name that is not found."""
    key, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    one = lambda kind, value, n=0: F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(n).alias("occurrence"))
    none = F.array().cast("array<struct<type:string,value:string,occurrence:int>>")
    entities = F.concat(
        F.array(one("EMAIL", F.concat(F.lit("user"), key, F.lit("@example.com")))),
        F.when(~segment.isin("BUILDING", "MACHINERY"), F.array(one("PHONE", F.concat(F.lit("+7 495 "), F.lpad(key, 7, "0"))))).otherwise(none),
        F.when(segment == "MACHINERY", F.array(one("CARD_NUMBER", F.lit("4111 1111 1111 1111")))).otherwise(none),
        F.when(segment == "BUILDING", F.array(one("PERSON", F.lit("M")))).otherwise(none),
    )
    return evaluation.evaluate(_notes(spark, sf_dir).select(key.alias("case_id"), F.lit("en").alias("locale"), "text", entities.alias("entities")))


def border_checks(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    header = F.when(key % 3 == 0, F.concat(F.lit("bearer "), name)).when(key % 3 == 1, name)
    client = F.when(key % 2 == 0, F.concat(F.lit("10.0.0."), key.cast("string")))
    path = F.concat(F.lit("C:\\in box\\"), name, F.lit(" v.2.docx"))
    conversation = gateway.conversation_id(F.when(key % 2 == 0, F.replace(name, F.lit("#"), F.lit("_"))).otherwise(name))
    made = _read(spark, sf_dir, "customer").select("c_custkey", gateway.limit_identity(header, client).alias("identity"), gateway.safe_stem(path).alias("stem"), conversation.alias("c"), gateway.too_large(name, 17).alias("too_large"))
    return made.select("c_custkey", "identity", "stem", "c.id", "c.error", "too_large")


_PARTS = {0: '"plain"', 1: '[{"type":"text"},{"type":"Image_URL"}]', 2: '{"type":"screenshot"}', 3: '[{"type":"text","text":"image"}]'}
_ANSWERS = {
    0: '{"choices":[{"message":{"role":"assistant","content":"done"}}]}',
    1: '{"choices":[]}',
    2: '{"choices":[{"message":{"role":"assistant","content":"a"}},{"message":{"role":"user","content":"b"}}]}',
    3: '{"choices":[{"message":{"role":"assistant","content":3}}]}',
    4: '{"choices":[{"message":{"role":"assistant","tool_calls":[{"type":"function","id":"1","function":{"name":"f","arguments":"{}"}},{"type":"function","function":{"name":"f","arguments":"{}"}}]}}]}',
    5: '{"choices":[{"message":{"role":"assistant","function_call":{"name":"f","arguments":{}}}}]}',
    6: '{"choices":[{"message":{"role":"assistant","content":null}}]}',
    7: "no json",
}


def _pick(key, values):
    out = F.lit(values[0])
    for k, v in values.items():
        out = F.when(key % len(values) == k, v).otherwise(out)
    return out


def unsafe_media(spark, sf_dir):
    body = F.concat(F.lit('{"messages":[{"role":"user","content":"see [image]"},{"role":"user","content":'), _pick(F.col("o_orderkey"), _PARTS), F.lit("}]}"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", gateway.unsafe_media(body).alias("media"))


def response_errors(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", gateway.response_error(_pick(F.col("o_orderkey"), _ANSWERS)).alias("error"))


def instruct_conversations(spark, sf_dir):
    messages = _read(spark, sf_dir, "conversations")
    token = F.concat(F.lit("<T"), F.col("conv_id").cast("string"), F.lit(">"))
    said = messages.select("conv_id").distinct().select("conv_id", gateway.instruction(F.array(token, token, F.lit(None).cast("string"))).alias("instruction"))
    return conversations.instruct(messages, said)


def policy_rule_errors(spark, sf_dir):
    """Parts as the rules of a file, many of which are wrong in one way or another."""
    key = F.col("p_partkey")
    words = lambda *w: F.array(*map(F.lit, w))
    kinds = F.when(key % 5 == 0, words("email", "EMAIL")).when(key % 7 == 0, words("PHONE", "SHOE")).otherwise(words("phone"))
    low = F.when(key % 11 == 0, 0.9).otherwise(0.2)
    rules = _read(spark, sf_dir, "part").select(
        key.alias("position"), F.when(key % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("r"), (key % 1000).cast("string"))).alias("id"), key.cast("double").alias("priority"),
        F.when(key % 17 == 0, "PERMIT").otherwise("TOKENIZE").alias("action"), F.lit("why").alias("reason"), F.lit(None).cast("array<string>").alias("obligations"),
        F.create_map(F.lit("entity_types"), kinds).alias("conditions"), F.create_map(F.lit("min_confidence"), low, F.lit("max_confidence"), F.lit(0.5)).alias("ranges"),
    )
    return policy.rule_errors(rules)


TOKEN = "<MG:" + "C" * 26 + ">"


def stream_restore(spark, sf_dir):
    """Messages that begin with a token, streamed in fragments of 16 characters and restored on the way."""
    schema = _read(spark, sf_dir, "conversations").schema
    said = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*").where("text is not null")
    said = said.select("conv_id", "turn", F.concat(F.lit(f"to {TOKEN} "), "text").alias("text"))
    last = (F.ceil(F.length("text") / 16) - 1).cast("int")
    cut = said.select("conv_id", "turn", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    parts = cut.select(
        F.concat_ws(":", "conv_id", "turn").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.substring("text", F.col("seq") * 16 + 1, F.lit(16)).alias("fragment"), (F.col("seq") == F.col("last")).alias("done"),
        F.array(F.struct(F.lit(TOKEN).alias("replacement"), F.lit("mail@example.com").alias("original"))).alias("pairs"),
    )
    shown = streamed(stream.restore(parts, None)).withColumnRenamed("text", "fragment")
    return conversations.reassemble(shown, ("stream_id",))


def stream_guard(spark, sf_dir):
    """Messages that begin with an approved and a foreign token as streams of chunks, guarded once they are whole."""
    schema = _read(spark, sf_dir, "conversations").schema
    said = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*").where("text is not null")
    said = said.select("conv_id", "turn", F.concat(F.lit(f"to {APPROVED}, not {FOREIGN}: "), "text").alias("text"))
    last = (F.ceil(F.length("text") / 40) - 1).cast("int")
    cut = said.select("conv_id", "turn", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    delta = F.struct(F.substring("text", F.col("seq") * 40 + 1, F.lit(40)).alias("content"))
    chunk = F.to_json(F.struct(F.array(F.struct(delta.alias("delta"), F.when(F.col("seq") == F.col("last"), "stop").alias("finish_reason"))).alias("choices")))
    pairs = F.array(F.struct(F.lit(APPROVED).alias("replacement"), F.lit("mail@example.com").alias("original")))
    chunks = cut.select(F.concat_ws(":", "conv_id", "turn").alias("stream_id"), F.col("seq").cast("long").alias("seq"), chunk.alias("chunk"), pairs.alias("pairs"))
    return streamed(stream_guards.guarded(chunks, None)).select("stream_id", "choice", "field", "guarded")


def conversation_store(spark, sf_dir):
    """Events as messages of their users' conversations by type, streamed; every seventh is blocked and adds nothing."""
    schema = _read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("event "), "event_id").alias("text")))
    turns = events.select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("conv_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 7 == 0, "blocked").otherwise("ok").alias("outcome"), message.alias("messages"))
    return streamed(store.conversations(turns, 7200)).select("seq", "begins", F.size("history").cast("long").alias("behind"), "after")


def _lined(batches):
    for doc_id, text in docx._each(batches):
        yield docx._batch([(str(doc_id), docx.from_lines((text or "").split("\n"), 7))], "id string, content binary")


def _relined(batches):
    for doc_id, content in docx._each(batches):
        yield docx._batch([(doc_id, None if content is None else "\n".join(docx.lines_of(content)))], "id string, struck string")


def docx_struck(spark, sf_dir):
    """Documents as Word files with a paragraph a line, in runs of seven characters, struck out and read back."""
    files = cut(_texts(spark, sf_dir).select("doc_id", "text").mapInArrow(_lined, "id string, content binary"))  # read three times
    made = cut(docx.struck(files, plain.actions([], False, False)))
    shown = made.select("id", "docx").mapInArrow(_relined, "id string, struck string")
    counts = made.select("id", "redactions", F.array_join("entity_types", ",").alias("types"), "error")
    return shown.join(counts, "id").select(F.col("id").cast("long").alias("doc_id"), "struck", F.col("redactions").cast("long").alias("redactions"), "types", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        risk_bucket_by_lang, risk_score, detect_documents, detect_pages, mask_semantic, mask_redact, mask_surrogate, rehydrate_roundtrip, validate_numbers, policy_first_match, policy_asserted, public_digest,
        principal_namespace, conversation_trim_count, conversation_trim_chars, turn_count, stream_reassemble, metrics_counts, latency_summary, p95_nearest_rank,
        sse_frames, rate_limit, vault_budget, vault_collisions, wire_numbers, wire_check, output_guard, detect_letters, transform_actions, restore_letters, guard_answers, mask_bodies, sealed_props,
        plain_notes, plain_verdict, strike_notes, evaluate_notes, border_checks, unsafe_media, response_errors, instruct_conversations, policy_rule_errors, stream_restore, stream_guard, conversation_store, docx_struck,
    ]
    return {f.__name__: f for f in found} | adapter_catalog.queries()


def _sum(text: str, weights: list[int]) -> str:
    return " + ".join(f"cast(substr({text}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights))


_LUHN = " + ".join(
    f"cast(substr(card, {i + 1}, 1) as int)" if i % 2 else f"(case when 2 * cast(substr(card, {i + 1}, 1) as int) > 9 then 2 * cast(substr(card, {i + 1}, 1) as int) - 9 else 2 * cast(substr(card, {i + 1}, 1) as int) end)"
    for i in range(16)
)


#: A letter's number within its nation decides its phone's surrogate; blocked letters count.
_LETTERS = """select c_custkey, c_mktsegment, cast(c_custkey as varchar) as k, '+1 202-555-' || lpad(cast(n as varchar), 4, '0') || ' ext ' || n as phone
    from (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer)"""


#: A note's parts.
_NOTES = """select c_custkey, c_mktsegment as s, 'user' || c_custkey || '@example.com' as email, case when c_mktsegment <> 'BUILDING' then '+7 495 ' || lpad(cast(c_custkey as varchar), 7, '0') end as phone,
    case when c_mktsegment = 'MACHINERY' then '4111 1111 1111 1111' end as card from customer"""


def oracle_sql() -> dict[str, str]:
    system = "coalesce(role = 'system', false)"
    return {
        "rehydrate_roundtrip": "select doc_id, text from documents",
        "stream_reassemble": "select conv_id, turn, text from conversations where text is not null",
        "sse_frames": "select conv_id as stream_id, row_number() over (partition by conv_id order by turn) - 1 as frame, text as data, cast(null as varchar) as error from conversations where text is not null",
        "rate_limit": """
            with recursive e as (select event_id, user_id, epoch_us(ts) as us from events where ts is not null),
            w as (select user_id, min(us) as s from e group by user_id union all select w.user_id, min(e.us) from w join e on e.user_id = w.user_id and e.us >= w.s + 3600000000 group by w.user_id, w.s),
            p as (select e.event_id, e.user_id, e.us, max(w.s) as s from e join w on w.user_id = e.user_id and w.s <= e.us group by all),
            r as (select *, row_number() over (partition by user_id, s order by us, event_id) as k from p)
            select event_id as request_id, case when k > 3 then greatest(cast(ceil((3600000000 - (us - s)) / 1000000.0) as bigint), 1) end as retry_after from r""",
        "vault_budget": """
            with r as (select c_nationkey as scope_id, c_custkey as pos, c_name as original, count(*) over w as n, sum(strlen(c_name)) over w as b from customer window w as (partition by c_nationkey order by c_custkey rows unbounded preceding))
            select scope_id, pos, original, case when n > 40 or b > 1024 then 'capacity' end as error from r""",
        "vault_collisions": "select c_nationkey as scope_id, c_mktsegment as replacement, count(distinct c_name) as originals from customer group by all having count(distinct c_name) > 1",
        "wire_numbers": "select event_id as request_id, case when json_type(props, '$.k') in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'unclassified numeric value at $.k' end as violation from events",
        "output_guard": "select doc_id, text as guarded from documents",
        "guard_answers": f"""
            select o_orderkey as request_id, '{{"choices":[{{"message":{{"content":"order ' || o_orderkey || ' for user' || o_orderkey || '@example.com, not [REDACTED_PROVIDER_TOKEN], cc [REDACTED_PROVIDER_EMAIL]"}}}}],"note":"ref [REDACTED_PROVIDER_TOKEN] ' || o_orderkey || '"}}' as rewritten from orders""",
        "mask_bodies": """
            select c_custkey as request_id, case when c_custkey % 10 <> 0 then '{"model":"m-1","input":"from [REDACTED_EMAIL] to ' || c_mktsegment || '","[REDACTED_EMAIL]":' || c_acctbal::decimal(12,2) || ',"[REDACTED_EMAIL]__MGKEY_2":{"s":"' || c_mktsegment || '"}}' end as rewritten from customer""",
        "sealed_props": """
            with p as (select event_id, props, case when json_type(props, '$.k') in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'unclassified numeric value at $.k' end as v from events)
            select event_id as request_id, v as violation, case when v is null then json(props)::varchar end as sealed, case when v is null then sha256(json(props)::varchar) end as sha256 from p""",
        "detect_letters": """
            with l as (select c_custkey, length(cast(c_custkey as varchar)) as k, greatest(length(cast(c_custkey as varchar)), 7) as p from customer)
            select c_custkey, 'EMAIL' as entity_type, cast(5 as bigint) as start, cast(21 + k as bigint) as "end", cast(0.97 as double) as confidence, 'VALID' as state from l
            union all select c_custkey, 'PHONE', 28 + k, 35 + k + 7, 0.82, 'UNVALIDATED' from l
            union all select c_custkey, 'CARD_NUMBER', 49 + k, 68 + k, 0.99, 'VALID' from l""",
        "transform_actions": f"""
            with l as ({_LETTERS})
            select c_custkey, case when c_mktsegment <> 'MACHINERY' then 'Mail ' || case when c_mktsegment = 'BUILDING' then 'user' || k || '@example.com' else '[REDACTED_EMAIL]' end || ', call ' || phone || ', card <MG_r_CARD_NUMBER_1> for ' || k || '.' end as masked,
              case when c_mktsegment = 'MACHINERY' then 'blocked' end as error, case when c_mktsegment = 'MACHINERY' then 'CARD_NUMBER' end as blocked from l""",
        "restore_letters": f"""
            with l as ({_LETTERS})
            select c_custkey, case when c_mktsegment <> 'MACHINERY' then 'Mail ' || case when c_mktsegment = 'BUILDING' then 'user' || k || '@example.com' else '[REDACTED_EMAIL]' end || ', call +7 495 ' || lpad(k, 7, '0') || ', card ' || '4111 1111 1111 1111 for ' || k || '.' end as restored from l""",
        "plain_notes": f"""
            with n as ({_NOTES})
            select c_custkey, 'EMAIL' as type, email as text, cast(5 as bigint) as start, 5 + length(email) as "end", 'regex' as method from n
            union all select c_custkey, 'PHONE', phone, 5 + length(email) + 7, 12 + length(email) + length(phone), 'regex' from n where phone is not null
            union all select c_custkey, 'CARD_NUMBER', card, 12 + length(email) + length(phone) + 7, 19 + length(email) + length(phone) + 19, 'regex' from n where card is not null""",
        "plain_verdict": f"with n as ({_NOTES}) select c_custkey, case when card is not null then 'BLOCK' when phone is not null then 'REDACT' else 'MASK' end as action, case when card is not null then 'CARD_NUMBER' else '' end as blocked from n",
        "strike_notes": f"""
            with n as (select *, c_custkey in (1, 8) as p from ({_NOTES}))
            select c_custkey, case when card is null then 'Mail ' || case when p then email else repeat('█', length(email)) end || case when phone is null then '' else ', call ' || repeat('█', length(phone)) end || '.' end as struck,
              case when card is null then cast((not p)::int + (phone is not null)::int as bigint) end as redactions, case when card is null then concat_ws(',', case when not p then 'EMAIL' end, case when phone is not null then 'PHONE' end) end as entity_types,
              case when card is null then '' else 'CARD_NUMBER' end as blocked from n""",
        "evaluate_notes": f"""
            with n as ({_NOTES}), c as (
              select 'EMAIL' as entity_type, count(*) as tp, 0::bigint as fp, 0::bigint as fn from n union all select 'PHONE', count(*) filter (phone is not null and card is null), count(*) filter (card is not null), 0 from n
              union all select 'CARD_NUMBER', count(*) filter (card is not null), 0, 0 from n union all select 'PERSON', 0, 0, count(*) filter (phone is null) from n),
            q as (select *, case when tp + fp = 0 then 1.0 else tp::double / (tp + fp) end as precision, case when tp + fn = 0 then 1.0 else tp::double / (tp + fn) end as recall from c where tp + fp + fn > 0)
            select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from q""",
        "border_checks": """
            select c_custkey, case when c_custkey % 3 = 2 then 'client:' || case when c_custkey % 2 = 0 then '10.0.0.' || c_custkey else 'unknown' end else 'token:' || sha256(c_name) end as identity,
              regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g') || 'v2' as stem, case when c_custkey % 2 = 0 then replace(c_name, '#', '_') end as id, case when c_custkey % 2 = 1 then 'conversation id' end as error, strlen(c_name) > 17 as too_large from customer""",
        "unsafe_media": "select o_orderkey, case o_orderkey % 4 when 1 then 'image_url' when 2 then 'screenshot' end as media from orders",
        "response_errors": """
            select o_orderkey, case o_orderkey % 8 when 1 then '$.choices: empty' when 2 then '$.choices[1].message.role: not the assistant'
              when 3 then '$.choices[0].message.content: neither text nor list' when 4 then '$.choices[0].message.tool_calls[1]: no function call'
              when 5 then '$.choices[0].message.function_call: name or arguments no text' when 6 then '$.choices[0].message: says nothing' when 7 then '$: no object' end as error from orders""",
        "instruct_conversations": """
            with p as (select conv_id, coalesce(min(turn) filter (role is distinct from 'system'), max(turn) + 1) as turn from conversations group by conv_id)
            select conv_id, turn, 1 as part, role, text from conversations
            union all select conv_id, turn, 0, 'system', 'Some values of this conversation are replaced by tokens: <T' || conv_id || '>. Where you mean such a value, write its token letter by letter; never guess what it stands for.' from p""",
        "policy_rule_errors": """
            with r as (select p_partkey as k, row_number() over (partition by case when p_partkey % 13 = 0 then null else p_partkey % 1000 end order by p_partkey) as n from part)
            select k as position, 'rules[' || k || ']' || coalesce(case when k % 13 = 0 then '.id: empty' when k > 1000000 then '.priority: not in 0..1000000' when k % 11 = 0 then '.conditions: least confidence over the most'
              when k % 5 = 0 then '.conditions.entity_types: one type twice' when k % 7 = 0 then '.conditions.entity_types: unknown type' when k % 17 = 0 then '.action: unknown value' end,
              '.id: taken') as error from r where k > 1000000 or k % 13 = 0 or k % 11 = 0 or k % 5 = 0 or k % 7 = 0 or k % 17 = 0 or n > 1""",
        "stream_restore": "select conv_id || ':' || turn as stream_id, 'to mail@example.com ' || text as text from conversations where text is not null",
        "stream_guard": "select conv_id || ':' || turn as stream_id, 0::int as choice, 'content' as field, 'to mail@example.com, not [REDACTED_PROVIDER_TOKEN]: ' || text as guarded from conversations where text is not null",
        "conversation_store": """
            with a as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id, event_type order by ts, event_id) as since from events),
            b as (select *, since is null or since >= 7200000000 as begins, (event_id % 7 <> 0)::int as ok from a),
            c as (select *, sum(begins::int) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as life from b),
            d as (select *, sum(ok) over (partition by user_id, event_type, life order by ts, event_id rows unbounded preceding) as n from c)
            select event_id as seq, begins, (case when n - ok <= 40 then n - ok else 38 + (n - ok - 41) % 3 end)::bigint as behind, (case when n <= 40 then n else 38 + (n - 41) % 3 end)::bigint as after from d""",
        "turn_count": "select conv_id, count(*) filter (role = 'user') as turns, count(*) as messages, cast(coalesce(sum(length(text)), 0) as bigint) as chars from conversations group by conv_id",
        "validate_numbers": f"""
            with n as (select o_orderkey, '4' || lpad(reverse(cast(o_orderkey as varchar)), 15, '0') as card, lpad(cast(o_orderkey as varchar), 10, '0') as inn, lpad(cast(o_orderkey as varchar), 11, '0') as snils from orders)
            select o_orderkey, ({_LUHN}) % 10 = 0 as luhn, (({_sum("inn", [2, 4, 10, 3, 5, 9, 4, 6, 8])}) % 11) % 10 = cast(substr(inn, 10, 1) as int) as inn,
              (({_sum("snils", [9, 8, 7, 6, 5, 4, 3, 2, 1])}) % 101) % 100 = cast(substr(snils, 10, 2) as int) as snils from n""",
        "policy_first_match": """
            with r as (select event_id, user_id % 10 = 0 as public, case when value >= 90 then 'large' when event_type = 'purchase' then 'purchase' when event_type in ('view', 'click') and value <= 50 then 'view' end as rule from events),
            p as (select *, public and coalesce(rule <> 'large', true) as open from r)
            select event_id, case when open then 'ALLOW' when rule = 'large' then 'REQUIRE_REVIEW' when rule = 'purchase' then 'TOKENIZE' when rule = 'view' then 'ALLOW' else 'BLOCK' end as action, case when open then null else rule end as rule_id from p""",
        "policy_asserted": """
            with r as (select c_custkey, c_custkey % 2 = 0 and c_custkey % 10 <> 0 and c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey % 3 in (0, 1) and (c_custkey % 4 = 0 or c_nationkey in (1, 2, 3)) as public from customer)
            select c_custkey, case when public then 'ALLOW' else 'TOKENIZE' end as action, case when public then null else 'person' end as rule_id from r""",
        "public_digest": "select c_custkey, sha256('PERSON' || chr(0) || lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g')))) as sha from customer",
        "principal_namespace": "select c_custkey, 'credential:' || substr(sha256(c_name), 1, 32) as tenant_id, 'credential:' || substr(sha256(c_name), 33, 32) as subject_id, 'bearer' as method from customer",
        "conversation_trim_count": f"""
            with r as (select *, {system} as s, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id, {system} order by turn) as a, row_number() over (partition by conv_id, {system} order by turn desc) as z from conversations)
            select conv_id, turn, role, text, row_number() over (partition by conv_id order by case when n > 4 and s then 0 else 1 end, turn) as position from r where n <= 4 or (s and a <= 2) or (not s and z <= 2)""",
        "conversation_trim_chars": f"""
            with r as (select *, sum(coalesce(length(text), 0)) over w as c, count(*) over w as k from conversations window w as (partition by conv_id order by {system}, turn rows between current row and unbounded following))
            select conv_id, turn, role, text from r where c <= 400 or k = 1""",
        "metrics_counts": """
            with e as (select case when regexp_full_match(upper(trim(event_type)), '[A-Z][A-Z0-9_]{0,63}') then upper(trim(event_type)) else 'UNKNOWN' end as label, event_id from events),
            g as (select label, count(*) as n, row_number() over (order by min(event_id), label) as r from e group by label)
            select case when r <= 3 then label else 'OTHER' end as label, cast(sum(n) as bigint) as n from g group by 1""",
        "latency_summary": "select event_type as stage, count(value) as count, sum(value * 1000) as total_ms, max(value * 1000) as maximum_ms from events group by event_type",
        "p95_nearest_rank": """
            with r as (select event_type as label, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
            select label, n, value from r where i = round_even((n - 1) * 0.95, 0)""",
    } | adapter_catalog.oracle_sql()
