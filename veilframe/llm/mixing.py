"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``exponent``, normalised. The exponent is
bisected: as flat as the target entropy asks, but no flatter than the repetition limit allows.
Budgets follow: the smallest token budget that shows every source once in full, dealt by weight.
A source realises its budget as epochs; each epoch permutes blocks of documents, and the last
epoch takes blocks, and then documents of one block, while the budget lasts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Entropy of the weights to reach, as a share of that of equal weights.
ENTROPY = 0.9
#: No source is shown more often than this.
REPETITIONS = 2.0
#: Tokens of a block, on average.
BLOCK_TOKENS = 50_000
#: Source totals are handled on the driver; beyond this many sources that is refused.
MAX_SOURCES = 1_000_000
BISECTIONS = 50
#: Scale of ``mix_key``: a source's schedule runs from 0 to this.
SCALE = 1_000_000_000
#: Running sums go over 16 to this power ranges of a hash, and then within each.
HASH_DIGITS = 3
#: A block table of at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 50_000


def weights(totals: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised shares to a power; sources without tokens have weight 0."""
    top = max(totals.values(), default=0)
    raw = {s: (n / top) ** exponent if n else 0.0 for s, n in totals.items()}
    whole = sum(raw.values())
    return {s: v / whole if whole else 0.0 for s, v in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def covering_budget(totals: dict[str, int], w: dict[str, float]) -> float:
    """The smallest budget under which each source's part is all its tokens at least."""
    return max((n / w[s] for s, n in totals.items() if n), default=0.0)


def repetitions(totals: dict[str, int], w: dict[str, float]) -> float:
    """The most epochs of any source under the covering budget."""
    b = covering_budget(totals, w)
    return max((b * w[s] / n for s, n in totals.items() if n), default=0.0)


def bisect(fits) -> float:
    """The boundary in 0..1 of a condition that holds towards 1 (or, at 0 too, 0 itself)."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def exponent_for(totals: dict[str, int], target: float = ENTROPY, most: float = REPETITIONS) -> float:
    """The exponent that just reaches the entropy target, or the repetition limit if that comes first.

    If even the untempered shares are flatter than the target, they stay (exponent 1).
    """
    n = sum(1 for v in totals.values() if v)
    goal = target * math.log(n) if n else 0.0
    # Entropy falls as the exponent grows: look for the largest exponent that still reaches it.
    reach = 1.0 - bisect(lambda x: entropy(weights(totals, 1.0 - x)) >= goal - 1e-12)
    limit = bisect(lambda a: repetitions(totals, weights(totals, a)) <= most + 1e-12)
    return max(reach, limit)


def token_count(text: Column) -> Column:
    """Words between ASCII white space: each one and what is before it becomes one letter, so that no words are made."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(marks, F.lit(" \t\n\v\f\r"))).cast("long")


def by_hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def schedule(docs: DataFrame, target: float = ENTROPY, most: float = REPETITIONS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` with a row for each showing: columns of ``docs`` plus mix_source, mix_tokens,
    mix_epoch, mix_block, mix_key.

    Sorting by ``mix_key`` interleaves the sources in proportion at block grain. A null source
    counts as ``''``; documents without tokens cost nothing and are shown in every epoch of
    their block. Rows with the same id are apart unless all columns agree, and then both stay.
    A column of ``docs`` that has the name of one of the new ones gives way to it.
    """
    shown, columns = _showings(docs, target, most, block_tokens)
    return shown.select(*[c.alias(n) for n, c in columns if n not in MIX], *MIX)


MIX = ("mix_source", "mix_tokens", "mix_epoch", "mix_block", "mix_key")


def _showings(docs: DataFrame, target: float = ENTROPY, most: float = REPETITIONS, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The showings, and names and columns in them of all columns of ``docs``.

    Columns of ``docs`` get numbers for names meanwhile, so that none can clash.
    """
    given = {n: f"_c{i}" for i, n in enumerate(docs.columns)}
    plain = docs.toDF(*given.values())
    source, text, id_ = (F.col(given[n]) for n in ("source", "text", "doc_id"))
    sized = plain.select("*", F.coalesce(source.cast("string"), F.lit("")).alias("mix_source"), token_count(text).alias("mix_tokens"))
    # One narrow pass over the texts: per source and fine bucket, so that a hot source is dealt out.
    spark = docs.sparkSession
    ids = F.coalesce(id_.cast("string"), F.lit(""))
    fine = F.conv(F.substring(by_hash("block", ids), 1, 7), 16, 10).cast("long")
    sized = sized.withColumn("mix_fine", fine)
    totals = {r["mix_source"]: int(r["t"]) for r in sized.groupBy("mix_source").agg(F.sum("mix_tokens").alias("t")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    w = weights(totals, exponent_for(totals, target, most))
    whole = covering_budget(totals, w)
    plan = [(s, n, max(n, int(whole * w[s] + 1e-6)), max(1, -(-n // block_tokens))) for s, n in totals.items()]
    sources = spark.createDataFrame(plan, "mix_source string, total long, budget long, blocks long")
    side = F.broadcast(sources) if len(plan) <= BROADCAST_ROWS else sources
    placed = sized.join(side, "mix_source").withColumn("mix_block", F.expr("mix_fine % blocks")).drop("mix_fine", "blocks", "total", "budget")
    blocks = cut(placed.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("size"))).join(side, "mix_source")
    rounds = blocks.withColumn("mix_epoch", F.explode(F.expr("sequence(0L, if(total > 0, (budget - 1) div total, 0L))")))
    # Running sums in two levels, as one source may have most blocks: over ranges of the hash, and within each.
    rounds = rounds.withColumn("hash", by_hash("epoch", F.col("mix_epoch"), F.col("mix_source"), F.col("mix_block"))).withColumn("range", F.substring("hash", 1, HASH_DIGITS))
    ranges = rounds.groupBy("mix_source", "mix_epoch", "range").agg(F.sum("size").alias("of_range"))
    by_range, within = Window.partitionBy("mix_source", "mix_epoch").orderBy("range"), Window.partitionBy("mix_source", "mix_epoch", "range").orderBy("hash", "mix_block")
    ranges = ranges.select("mix_source", "mix_epoch", "range", F.coalesce(F.sum("of_range").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rounds = rounds.join(ranges, ["mix_source", "mix_epoch", "range"])
    before = F.col("before") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = cut(
        rounds.withColumn("left", F.col("budget") - F.col("mix_epoch") * F.col("total") - before)
        .withColumn("mix_key", F.expr(f"(budget - left) * cast({SCALE} as decimal(20,0)) div greatest(budget, 1L)").cast("long"))
        .where("left > 0 or size = 0")
        .select("mix_source", "mix_block", "mix_epoch", "mix_key", "left", (F.col("size") <= F.col("left")).alias("all"))
    )
    small = rounds.count() <= BROADCAST_ROWS
    tables = {k: rounds.where(F.col("all") if k else ~F.col("all")).drop("all") for k in (True, False)}
    shown = [placed.join(F.broadcast(t) if small else t, ["mix_source", "mix_block"]) for t in tables.values()]
    # One block a source at most is taken in part, in an order of its own.
    inside = Window.partitionBy("mix_source", "mix_block", "mix_epoch").orderBy(by_hash("doc", F.col("mix_epoch"), ids), *names_of(plain, given["text"]))
    part = shown[1].withColumn("upto", F.sum("mix_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= left").drop("upto")
    cols = [*plain.columns, *MIX]
    return shown[0].select(cols).unionByName(part.select(cols)), [(n, F.col(c)) for n, c in given.items()]


def names_of(docs: DataFrame, text: str) -> list[str]:
    """Columns that order rows of one id: those that compare, without the text."""
    return [f.name for f in docs.schema if f.dataType.typeName() in ("long", "integer", "string") and f.name != text]


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The columns of ``docs`` alone, a row for each showing."""
    shown, columns = _showings(docs, **settings)
    return shown.select(*[c.alias(n) for n, c in columns])


def oracle(target: float = ENTROPY, most: float = REPETITIONS, block_tokens: int = BLOCK_TOKENS) -> str:
    """SQL for the rows of query op1_mixing over ``documents``."""
    raw = "list_transform(ns, lambda x: pow(x / top, {a}))"
    w = f"list_transform({raw}, lambda v: v / list_sum({raw}))"
    entropy_of = f"-list_sum(list_transform({w}, lambda v: v * ln(v)))"
    # With shares w of sources of n tokens, the budget is max(n / w) and a source's repetitions are budget * w / n.
    over = "list_transform(range(1, len(ns) + 1), lambda i: {w}[i] / ns[i])".replace("{w}", w)
    repeats = f"list_max({over}) / list_min({over})"

    def steps(name: str, exponent: str, fits: str) -> str:
        at = lambda a: fits.replace("{a}", exponent.replace("{x}", a))
        mid = "((low + high) / 2)"
        return f"""{name}(i, low, high) as (select 0, 0::double, case when {at('0::double')} then 0::double else 1::double end from l
              union all select i + 1, case when {at(mid)} then low else {mid} end, case when {at(mid)} then {mid} else high end from {name}, l where i < {BISECTIONS})"""

    return f"""
        with recursive d as (select doc_id, coalesce(source, '') as source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as n_tokens,
          ('0x' || substr(md5('block:' || coalesce(cast(doc_id as varchar), '')), 1, 7))::bigint as fine from documents),
        t as (select source, cast(sum(n_tokens) as bigint) as total from d group by source),
        l as (select list(total::double) filter (total > 0) as ns, max(total)::double as top, {target} * ln(count(*) filter (total > 0)) as goal from t),
        {steps("flat", "(1 - {x})", f"{entropy_of} >= goal - 1e-12")},
        {steps("seldom", "{x}", f"{repeats} <= {most} + 1e-12")},
        x as (select greatest(1 - (select high from flat where i = {BISECTIONS}), (select high from seldom where i = {BISECTIONS})) as a),
        v as (select source, total, case when total > 0 then pow(total / top, a) / list_sum({raw.format(a="a")}) else 0 end as w from t, l, x),
        b as (select *, greatest(total, cast(floor(max(total / w) filter (total > 0) over () * w + 1e-6) as bigint)) as budget, greatest(1, (total + {block_tokens - 1}) // {block_tokens}) as blocks from v),
        p as (select d.*, fine % blocks as block from d join b using (source)),
        s as (select source, block, cast(sum(n_tokens) as bigint) as size from p group by all),
        e as (select *, unnest(range(0, 1 + case when total > 0 then (budget - 1) // total else 0 end)) as epoch from s join b using (source)),
        r as (select *, budget - epoch * total - coalesce(sum(size) over (partition by source, epoch order by md5('epoch:' || epoch || ':' || source || ':' || block), block rows between unbounded preceding and 1 preceding), 0) as room from e),
        k as (select source, block, epoch, size, room, cast((budget - room) * {SCALE}::hugeint // greatest(budget, 1) as bigint) as mix_key from r where room > 0 or size = 0),
        o as (select doc_id, source, n_tokens, epoch, block, mix_key, size <= room as whole, room,
          sum(n_tokens) over (partition by source, block, epoch order by md5('doc:' || epoch || ':' || coalesce(cast(doc_id as varchar), '')), doc_id rows unbounded preceding) as upto from p join k using (source, block))
        select doc_id, source, n_tokens, epoch, block, mix_key from o where whole or upto <= room"""
