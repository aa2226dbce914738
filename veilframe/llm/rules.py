"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule rejects a document. On a sample the cascade estimates how often each rule rejects and
how long it takes, and then tries the rules by rejections per cost, the best first, inside one
``CASE WHEN``, so that a document rejected early costs no more. The order changes the cost and
``rejected_by``, never which documents are kept. The counts that every row of the result shows
are made before the cascade and are most of its cost.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

#: The sample that costs and selectivities are estimated on has about this many rows.
SAMPLE_ROWS = 1000
#: A rule is timed over so many copies of the sample, so often.
REPLICAS, REPEATS = 20, 3
#: ASCII white space separates words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def without(text: str, chars: str) -> str:
    """SQL for how many code points of ``text`` are among ``chars``."""
    return f"(char_length({text}) - char_length(translate({text}, '{chars}', '')))"


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Hashes of all windows of five words; ``h`` is the array of word hashes.
_GRAMS = "transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"
#: Start positions, in order, of the windows that another window equals. ``s`` sorts (hash, start).
_STARTS = "sort_array(transform(filter(s, (x, i) -> (i > 0 and s[i - 1].g = x.g) or (i + 1 < size(s) and s[i + 1].g = x.g)), x -> x.i))"
#: Words under windows that start at ``p``.
_COVERED = f"aggregate(transform(p, (x, i) -> if(i + 1 < size(p), least({WINDOW}, p[i + 1] - x), {WINDOW})), 0, (a, b) -> a + b)"


def repeat_words() -> str:
    """SQL for the words of ``words`` that lie in windows found twice or more."""
    sorted_ = "sort_array(transform(g, (x, i) -> struct(x as g, i as i)))"
    found = let(sorted_, "s", let(_STARTS, "p", _COVERED))
    grams = let(_GRAMS, "g", f"if(size(array_distinct(g)) = size(g), 0, {found})")
    return f"if(size(words) < {WINDOW}, 0, {let('transform(words, w -> xxhash64(w))', 'h', grams)})"


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts that the rules use; a null text has no words.

    Columns: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words.
    """
    words = f"array_remove(split(text, r'{SPACE}', -1), '')"
    lines = r"filter(split(text, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')"
    spaces = " \t\n\x0b\x0c\r"
    split = docs.select("doc_id", whole_text().alias("text")).withColumn("words", F.expr(words)).withColumn("lines", F.expr(lines))
    return split.select(
        "doc_id",
        "text",
        F.expr("cast(size(words) as long)").alias("n_words"),
        F.expr(f"cast(char_length(translate(text, '{spaces}', '')) as long)").alias("word_chars"),
        F.expr(f"cast({without('text', SYMBOLS)} as long)").alias("n_symbols"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(f"cast({repeat_words()} as long)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The fixed rules: too short, or too much of it repeated."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def rules() -> list[Rule]:
    """The production rules, over the columns of :func:`with_counts`."""
    return [
        Rule("symbols", F.expr("10 * n_symbols > n_words")),
        Rule("duplicate_lines", F.expr("10 * n_dup_lines > 3 * n_lines")),
        Rule("word_length", F.expr("word_chars > 15 * n_words or word_chars < 2 * n_words")),
        Rule("capitals", F.expr(f"2 * {without('text', CAPITALS)} > word_chars")),
        Rule("digits", F.expr(f"10 * {without('text', DIGITS)} > 3 * word_chars")),
        Rule("placeholder", F.expr("contains(lower(text), 'lorem ipsum')")),
    ]


def ordered(docs: DataFrame, given: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``given`` by estimated rejections per cost, each among the rows that those before it leave.

    The sample is drawn by ``DataFrame.sample``, has ``sample_rows`` rows on average, and leaves
    out what ``base_failed`` ends anyway, unless that is all. An empty sample keeps the order. A rule's cost is the
    time of a job over the sample, taken ``REPLICAS`` times, less that of a job without a rule:
    the median of ``REPEATS``, rounded to a power of two (a fourth of the dearest at least), so
    that small differences of timing do not change the order.
    """
    total = docs.select("doc_id").count()
    sample = cut(with_counts(docs.sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=7)))
    bit = lambda k: F.coalesce(given[k].rejects, F.lit(False)).cast("int") * (1 << k)
    for rows in (sample.where(~base_failed()), sample):
        counted = rows.groupBy(sum(map(bit, range(len(given))), F.lit(0)).alias("mask")).agg(F.count("*").alias("n")).collect()
        if masks := {r["mask"]: r["n"] for r in counted}:
            break
    else:
        return given
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPLICAS))))

    def timed(value: Column) -> float:
        took = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            many.agg(F.sum(value)).collect()
            took.append(time.perf_counter() - began)
        return sorted(took)[REPEATS // 2]

    timed(F.col("copy"))  # warm
    empty = timed(F.col("copy"))
    spent = [timed(F.when(r.rejects, F.col("copy"))) - empty for r in given]
    least = max(max(spent) / 4, 1e-3)
    return greedy(given, masks, [2.0 ** round(math.log2(max(t, least))) for t in spent])


def greedy(given: list[Rule], masks: dict[int, int], cost: list[float]) -> list[Rule]:
    """Rules by rejections per cost among rows not rejected yet; ``masks`` counts rows by the bits of the rules that reject them.

    Of equals the cheaper comes first, then the earlier; rules that reject nothing more come last.
    """
    left, out = list(range(len(given))), []
    while left:
        gain = {k: sum(n for m, n in masks.items() if m >> k & 1) for k in left}
        best = min(left, key=lambda k: (-gain[k] / cost[k], cost[k], k))
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
        left.remove(best)
        out.append(given[best])
    return out


def cascade(order: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null."""
    out = F.when(base_failed(), F.lit("base"))
    for rule in order:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def judge(docs: DataFrame, given: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base_failed, rejected_by and kept for every row of ``docs``."""
    counted = with_counts(docs)
    by = cascade(ordered(docs, given or rules(), sample_rows))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), by.alias("rejected_by"), by.isNull().alias("kept"),
    )


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
grams as (
  select doc_id, i, count(*) over (partition by doc_id, gram) as n
  from (select doc_id, i, array_to_string(words[i:i + 4], ' ') as gram
        from (select doc_id, words, unnest(generate_series(1, len(words) - 4)) as i from d where len(words) >= 5))),
covered as (
  select doc_id, count(distinct i + k) as n
  from (select doc_id, i, unnest([0, 1, 2, 3, 4]) as k from grams where n > 1) group by doc_id),
c as (
  select d.doc_id, text, cast(len(words) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from d left join covered using (doc_id)),
b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines
      or word_chars > 15 * n_words or word_chars < 2 * n_words
      or 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > word_chars
      or 10 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > 3 * word_chars
      or contains(lower(text), 'lorem ipsum') as ruled_out
  from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ruled_out as kept
from b
"""
