"""Masking: replacements for detections, the vault that restores them, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import spans, splice
from ..plans.intermediate import cut
from .detect import detect

#: Token grammars.
OPAQUE = r"<MG:[A-Z2-7]{26}>"
SEMANTIC = r"<MG_[A-Za-z0-9]+_[A-Z_]+_\d+>"
# Fixed values end.


def opaque_token(scope: Column, original: Column, key: str) -> Column:
    """``<MG:`` and 26 base-32 characters of a keyed SHA-256, so a task that runs twice agrees."""
    hexed = F.sha2(F.concat(F.lit(key), F.lit("\0"), scope, F.lit("\0"), original), 256)
    groups = []
    for k in (0, 10, 20):  # 40 bits are ten hex digits or eight of base 32
        groups.append(F.lpad(F.conv(F.substring(hexed, k + 1, 10), 16, 32), 8, "0"))
    last = F.conv(F.substring(hexed, 31, 2), 16, 10).cast("int") * 4
    groups.append(F.lpad(F.conv(last.cast("string"), 10, 32), 2, "0"))
    return F.concat(F.lit("<MG:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.lit(">"))


def semantic_token(namespace: str, entity_type: Column, n: Column) -> Column:
    return F.concat(F.lit(f"<MG_{namespace}_"), entity_type, F.lit("_"), n, F.lit(">"))


def surrogate(entity_type: Column, n: Column) -> Column:
    """The ``n``-th synthetic value of a type; types without a template get their name in title case."""
    templates = {
        "PERSON": F.format_string("Demo Person %d", n),
        "ORG": F.format_string("Example Organization %d", n),
        "EMAIL": F.format_string("demo.%d@example.test", n),
        "PHONE": F.format_string("+1 202-555-%04d ext %d", n % 10_000, n),
        "IP_ADDRESS": F.format_string("198.51.%d.%d", F.floor(n / 254) % 254, n % 254 + 1),
        "DOMAIN": F.format_string("demo-%d.example.test", n),
        "URL": F.format_string("https://example.test/resource/%d", n),
        "API_KEY": F.format_string("sk-test-synthetic-%024d", n),
        "FILE_PATH": F.format_string("C:\\Example\\Synthetic\\file-%d.txt", n),
        "MONEY": F.concat(F.lit("$"), F.format_number(n, 0), F.lit(".00")),
        "CARD_NUMBER": F.format_string("0000 0000 %04d %04d", F.floor(n / 10_000), n % 10_000),
        "BANK": F.format_string("Example Bank %d", n),
        "LOCATION": F.format_string("Example Location %d", n),
    }
    title = F.array_join(F.transform(F.split(entity_type, "(?<=[^A-Za-z])(?=[A-Za-z])"), F.initcap), "")
    out = F.concat(F.lit("Synthetic "), title, F.lit(" "), n.cast("string"))
    for name, made in templates.items():
        out = F.when(entity_type == name, made).otherwise(out)
    return out


def vault(found: DataFrame, mode: str, key: str = "", namespace: str = "r") -> DataFrame:
    """scope_id, entity_type, original, replacement, restore of distinct originals in each scope.

    ``found`` has scope_id, entity_type, value and pos. The first appearance of a value decides
    its type. Modes: placeholder, semantic_placeholder, surrogate, redact.
    """
    first = found.groupBy("scope_id", F.col("value").alias("original")).agg(F.min_by("entity_type", "pos").alias("entity_type"), F.min("pos").alias("pos"))
    if mode == "placeholder":
        out = first.withColumn("replacement", opaque_token(F.coalesce(F.col("scope_id").cast("string"), F.lit("")), F.col("original"), key))
    elif mode == "redact":
        out = first.withColumn("replacement", F.concat(F.lit("[REDACTED_"), "entity_type", F.lit("]")))
    else:
        order = Window.partitionBy("scope_id", "entity_type").orderBy("pos", "original")
        out = first.withColumn("n", F.row_number().over(order))
        name = semantic_token(namespace, F.col("entity_type"), F.col("n"))
        if mode == "surrogate":
            name = surrogate(F.col("entity_type"), F.col("n"))
        out = out.withColumn("replacement", name)
    return out.select("scope_id", "entity_type", "original", "replacement", F.lit(mode != "redact").alias("restore"))


def mask(df: DataFrame, mode: str = "semantic_placeholder", key: str = "", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``masked``, vault) for ``df`` with scope_id, ``text`` and detections.

    ``df`` is written once, as detections are read for the vault and for the rows. Detections
    meet the vault one by one, so a scope with most rows is no row or map of its own. A null
    scope is a scope. A detection without a replacement is redacted.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    found = rows.select("_row", "scope_id", F.explode("detections").alias("d")).select("_row", "scope_id", "d.entity_type", "d.value", F.col("d.start").alias("pos"), "d.start", "d.end")
    table = cut(vault(found, mode, key))
    return spliced(rows, replaced(found, table), text).drop("_row"), table


def outside_tokens(found: Column, text: Column) -> Column:
    """The detections ``found`` in ``text`` that do not lie inside one of its opaque tokens, whose letters may look like an IBAN."""
    tokens = spans(text, OPAQUE, cue="<MG:")
    return F.filter(found, lambda d: ~F.exists(tokens, lambda t: (t["start"] <= d["start"]) & (d["end"] <= t["end"])))


def mask_all(df: DataFrame, key: str = "", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """As :func:`mask` with opaque tokens, and masked again until nothing is found outside the tokens; without detections.

    Of findings that overlap one is masked; what is left of the others may be a finding of the
    masked text. Only texts with findings are read again, and those that change.
    """
    rows, table = mask(df, "placeholder", key, text)
    done, todo = rows.where(F.coalesce(F.size("detections"), F.lit(0)) <= 0).drop("detections"), rows.where(F.size("detections") > 0)
    cores = df.sparkSession.sparkContext.defaultParallelism
    while True:
        seen = detect(todo.drop("detections").repartition(cores), "masked")  # few bytes, of which joins make few partitions
        seen = cut(seen.withColumn("detections", outside_tokens(F.col("detections"), F.col("masked"))))
        done = done.unionByName(seen.where(F.size("detections") == 0).drop("detections"))
        left = seen.where(F.size("detections") > 0)
        if left.isEmpty():
            return done, table
        todo, more = mask(left.withColumnRenamed("masked", "_said"), "placeholder", key, "_said")
        todo = todo.drop("_said")
        known = table.select(F.col("scope_id").alias("k_scope"), F.col("original").alias("k_original"))
        table = cut(table.unionByName(more.join(known, F.col("scope_id").eqNullSafe(F.col("k_scope")) & (F.col("original") == F.col("k_original")), "left_anti")))


def replaced(found: DataFrame, table: DataFrame) -> DataFrame:
    """_row and ``cuts``: the replacements of its detections from their scope's vault, in text order."""
    known = table.select(F.col("scope_id").alias("v_scope"), F.col("original").alias("v_original"), "replacement")
    joined = found.join(known, F.col("scope_id").eqNullSafe(F.col("v_scope")) & (F.col("value") == F.col("v_original")), "left")
    put = F.coalesce("replacement", F.concat(F.lit("[REDACTED_"), "entity_type", F.lit("]")))
    return joined.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", put.alias("replacement")))).alias("cuts"))


def spliced(rows: DataFrame, cuts: DataFrame, text: str) -> DataFrame:
    """``rows`` plus ``masked``: the text with its cuts; only rows with detections are joined."""
    with_any = rows.where(F.size("detections") > 0).join(cuts, "_row", "left")
    done = with_any.withColumn("masked", splice(F.col(text), F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int,replacement:string>>")))).drop("cuts")
    others = rows.where(F.coalesce(F.size("detections"), F.lit(0)) <= 0).withColumn("masked", F.col(text))
    return done.unionByName(others)


PAIRS = "array<struct<replacement:string,original:string>>"
#: The most replacements without a grammar that are all searched for in each text of their scope.
SEARCHED = 256
#: The most shapes by which pieces of texts are chosen.
SHAPES = 200


def scope_pairs(df: DataFrame, table: DataFrame, column: str = "masked") -> DataFrame:
    """``df`` plus ``pairs``: the restorable replacements of its scope that stand in ``column``.

    Tokens are taken from the text and looked up one by one. Surrogates have no grammar: those of a
    scope with ``SEARCHED`` at most are all given, those of a larger one if they stand in the text.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    known = table.where("restore").select(F.col("scope_id").alias("v_scope"), "replacement", "original")
    token = F.col("replacement").rlike(rf"\A(?:{OPAQUE}|{SEMANTIC})\z")
    used = rows.select("_row", "scope_id", F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(f"{OPAQUE}|{SEMANTIC}"), F.lit(0)))).alias("used"))
    by_token = used.join(known.where(token), F.col("scope_id").eqNullSafe(F.col("v_scope")) & (F.col("used") == F.col("replacement")))
    gathered = F.collect_list(F.struct("replacement", "original"))
    by_token = by_token.groupBy("_row").agg(gathered.alias("_tokens"))
    plain = known.where(~token & (F.col("replacement") != ""))
    sized = plain.groupBy("v_scope").agg(F.count("*").alias("n")).select(F.col("v_scope").alias("n_scope"), "n")
    of_scope = F.col("v_scope").eqNullSafe(F.col("n_scope"))
    others = plain.join(sized.where(F.col("n") <= SEARCHED), of_scope, "left_semi").groupBy("v_scope").agg(gathered.alias("_others"))
    many = cut(plain.join(sized.where(F.col("n") > SEARCHED), of_scope, "left_semi"))
    none = F.array().cast(PAIRS)
    joined = rows.join(by_token, "_row", "left").join(others, F.col("scope_id").eqNullSafe(F.col("v_scope")), "left").drop("v_scope")
    given = F.concat(F.coalesce("_tokens", none), F.coalesce("_others", none))
    if not many.isEmpty():
        joined = joined.join(_standing(rows.select("_row", "scope_id", F.col(column).alias("_said")), many).groupBy("_row").agg(gathered.alias("_standing")), "_row", "left")
        given = F.concat(given, F.coalesce("_standing", none))
    return joined.withColumn("pairs", given).drop("_row", "_tokens", "_others", "_standing")


def _standing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """_row, replacement, original of the replacements ``known`` that stand in texts (_row, scope_id, _said) of their scope.

    They are met by their last 1, 2, 4 or 8 characters. Where these have few shapes (their digits
    made equal), only pieces of such a shape are taken from the texts.
    """
    length = F.length("replacement")
    size = F.when(length >= 8, 8).when(length >= 4, 4).when(length >= 2, 2).otherwise(1)
    known = known.withColumn("size", size).withColumn("end", F.expr("right(replacement, size)"))
    shape = lambda c: F.translate(c, "0123456789", "9" * 10)
    large = rows.join(known.select(F.col("v_scope").alias("n_scope")).distinct(), F.col("scope_id").eqNullSafe(F.col("n_scope")), "left_semi")
    met = None
    for (n,) in sorted(known.select("size").distinct().collect()):  # four sizes at most
        ends = known.where(F.col("size") == n)
        pieces = F.array_distinct(F.regexp_extract_all("_said", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        shapes = [r[0] for r in ends.select(shape(F.col("end"))).distinct().limit(SHAPES + 1).collect()]
        if len(shapes) <= SHAPES:
            pieces = F.filter(pieces, lambda g: shape(g).isin(*shapes))  # noqa: B023
        taken = large.select("_row", "scope_id", F.explode(pieces).alias("piece"))
        hit = taken.join(ends, F.col("scope_id").eqNullSafe(F.col("v_scope")) & (F.col("end") == F.col("piece"))).select("_row", "replacement", "original")
        met = hit if met is None else met.unionByName(hit)
    return met.join(large.select("_row", "_said"), "_row").where(F.contains("_said", "replacement")).select("_row", "replacement", "original")


def restore(df: DataFrame, table: DataFrame, column: str = "masked") -> DataFrame:
    """``df`` plus ``restored``: tokens of its scope replaced, the longest first."""
    paired = scope_pairs(df, table, column)
    longest = F.array_sort(F.transform("pairs", lambda p: F.struct((-F.length(p["replacement"])).alias("n"), p["replacement"].alias("r"), p["original"].alias("o"))))
    return paired.withColumn("restored", F.aggregate(longest, F.col(column), lambda t, p: F.replace(t, p["r"], p["o"]))).drop("pairs")


def injected(text: Column) -> Column:
    """Whether incoming text already holds reserved tokens."""
    return F.coalesce(text.rlike(f"{OPAQUE}|{SEMANTIC}"), F.lit(False))


def over_budget(table: DataFrame, order: str, most_rows: int = 5_000, most_bytes: int = 2 << 20) -> DataFrame:
    """``table`` plus ``error``: a scope's mappings past its budget of rows or of original bytes.

    Mappings are taken by ``order``; those after the first refused one are refused too.
    """
    upto = Window.partitionBy("scope_id").orderBy(order, "original").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = table.withColumns({"_n": F.count("*").over(upto), "_bytes": F.sum(F.octet_length("original")).over(upto)})
    over = (F.col("_n") > max(most_rows, 1)) | (F.col("_bytes") > max(most_bytes, 1024))
    return counted.withColumn("error", F.when(over, "capacity")).drop("_n", "_bytes")


def collisions(table: DataFrame) -> DataFrame:
    """scope_id, replacement, originals: restorable replacements that several originals share."""
    return table.where("restore").groupBy("scope_id", "replacement").agg(F.count_distinct("original").alias("originals")).where("originals > 1")


def pruned(table: DataFrame, retained: DataFrame, text: str = "text") -> DataFrame:
    """The restorable rows of ``table`` whose replacement stands in a retained text of its scope.

    ``retained`` has scope_id and ``text``, a row for each string of what a conversation keeps,
    member names included. Tokens are taken from the texts and met by equality. Replacements
    without a grammar are searched for in the texts of their scope, or, in a scope with more than
    ``SEARCHED``, met by their last 1, 2, 4 or 8 characters before what meets is searched for. Null and empty texts and replacements hold and keep nothing.
    """
    known = cut(table.where(F.col("restore") & (F.col("replacement") != "")).withColumn("_map", F.monotonically_increasing_id()))
    rows = cut(retained.where(F.col(text) != "").select(F.monotonically_increasing_id().alias("_row"), F.col("scope_id").alias("r_scope"), F.col(text).alias("_said")))
    is_token = F.col("replacement").rlike(rf"\A(?:{OPAQUE}|{SEMANTIC})\z")
    same = F.col("scope_id").eqNullSafe(F.col("r_scope"))
    used = rows.select("r_scope", F.explode(F.regexp_extract_all("_said", F.lit(f"{OPAQUE}|{SEMANTIC}"), F.lit(0))).alias("_used")).distinct()
    by_token = known.where(is_token).join(used, same & (F.col("replacement") == F.col("_used")), "left_semi").select("_map")
    plain = known.where(~is_token).select("scope_id", "_map", "replacement")
    sized = plain.groupBy("scope_id").agg(F.count("*").alias("n")).select(F.col("scope_id").alias("n_scope"), "n")
    of_scope = F.col("scope_id").eqNullSafe(F.col("n_scope"))
    gathered = plain.join(sized.where(F.col("n") <= SEARCHED), of_scope, "left_semi").groupBy("scope_id").agg(F.collect_list(F.struct("_map", "replacement")).alias("_all"))
    found = rows.join(gathered, same).select(F.explode(F.filter("_all", lambda m: F.contains(F.col("_said"), m["replacement"]))).alias("m")).select("m._map").distinct()
    length = F.length("replacement")
    size = F.when(length >= 8, 8).when(length >= 4, 4).when(length >= 2, 2).otherwise(1)
    plain = plain.join(sized.where(F.col("n") > SEARCHED), of_scope, "left_semi").withColumn("size", size).withColumn("end", F.expr("right(replacement, size)"))
    met = None
    for (n,) in sorted(plain.select("size").distinct().collect()):  # four sizes at most
        # Only texts of scopes with many mappings are taken apart.
        large = rows.join(sized.where(F.col("n") > SEARCHED), F.col("r_scope").eqNullSafe(F.col("n_scope")), "left_semi")
        grams = large.select("_row", "r_scope", F.explode(F.array_distinct(F.regexp_extract_all("_said", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))).alias("gram"))
        hit = plain.where(F.col("size") == n).join(grams, same & (F.col("end") == F.col("gram"))).select("_row", "_map", "replacement")
        met = hit if met is None else met.unionByName(hit)
    kept = by_token.unionByName(found)
    if met is not None:
        kept = kept.unionByName(met.join(rows.select("_row", "_said"), "_row").where(F.contains("_said", "replacement")).select("_map").distinct())
    return known.join(kept, "_map", "left_semi").drop("_map")
