"""Secret scans: fixed shapes plus a password guess-cost model.

Fixed shapes (``assign``, ``access``, ``hex``) are found by regular expressions. Then values
that stand in a credential context (``password is ...``, ``pwd: ...``) are priced: a dynamic
programme finds the segmentation into dictionary words, dates, repeats, keyboard walks and
brute-force spans with the least total log10 of guesses. Values that cost at least
``MIN_LOG10_GUESSES`` become ``guess`` spans. The dictionaries are common passwords and the words
that most documents hold, counted over all of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

KINDS = ("assign", "access", "hex", "guess")
#: A value in a credential context counts as a secret from this many log10 guesses on.
MIN_LOG10_GUESSES = 6.0
MIN_VALUE_CHARS = 6

# The shapes that the scan must find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Fixed values end.

CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)s?|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key|auth[ _-]?key)"
    r"[\"']?(?:\s*(?::|=>|->|=)\s*|\s+(?:is|was)(?!(?u:\w))\s*:?\s*)[\"'`]?([^\s\"'`,;()\[\]{}]+)",
    re.I | re.A,
)
#: Texts without any of these (in lower case) need neither ASSIGN nor CONTEXT.
CUES = ("pass", "pwd", "secret", "token", "credential", "api", "access", "auth")

#: Common passwords and words, most common first: the rank is the number of guesses.
WORDS = tuple(
    """password qwerty dragon monkey letmein football baseball welcome master login admin princess sunshine shadow
    superman batman trustno iloveyou ashley michael jordan hunter ranger secret summer winter spring autumn flower
    love hello freedom whatever ninja mustang access killer pepper ginger soccer hockey cheese computer internet
    the and for that this with you not are from have was his her they will would there their what about which when
    your said each time into has more her two like him see could make than first been its who now people my made
    over did down only way find use may water long little very after word called just where most know user test
    guest root changeme default temp example please enter required none null true false string value here
    horse correct battery staple green blue red black white orange house money music world star tiger""".split()
)
#: The dictionary of the corpus holds at most so many words, for the broadcast: those in most documents ...
DICTIONARY = 50_000
#: ... and in so many at least.
LEAST_DOCUMENTS = 2
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujm")
_LEET = str.maketrans("@4301!$57", "aaeoiisst"[:9])
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


class GuessCost:
    """log10 of the guesses that the cheapest segmentation of a value takes."""

    #: Each further segment multiplies the guesses by this (log10): an attacker tries orders.
    STEP = math.log10(2.0)

    def __init__(self, words: Iterable[str] = WORDS, frequent: Iterable[str] = ()):
        self.rank = {}
        for dictionary in (words, frequent):  # each by its own ranks; the least counts
            for i, w in enumerate(dictionary, 1):
                self.rank[w] = min(i, self.rank.get(w, i))
        self.longest = max(map(len, self.rank), default=0)
        self.walks = [s for row in ROWS for s in (row, row[::-1])]

    @staticmethod
    def brute(value: str) -> float:
        """log10 of the alphabet that the characters of a value need."""
        size = 0
        for low, n in ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26)):
            size += n * any(map(low, value))
        if any(not c.isalnum() for c in value):
            size += 33
        if any(ord(c) > 127 for c in value):
            size += 100
        return math.log10(max(size, 10))

    def segments(self, value: str) -> Iterator[tuple[int, int, str, float]]:
        """Known patterns in a value: (start, end, kind, log10 guesses)."""
        n, low = len(value), value.lower()
        if len(low) != n:  # a few letters have longer lower forms
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(_LEET)
        periods = [self.period(value, unit) for unit in range(1, min(8, n // 2) + 1)]
        prices: dict[str, float] = {}
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                rank = self.rank.get(low[i:j])
                extra = 0.0
                if rank is None and (rank := self.rank.get(plain[i:j])) is not None:
                    extra = math.log10(2)
                if rank is not None:
                    if value[i:j] != low[i:j]:
                        extra += math.log10(2) if value[i:j].istitle() or value[i:j].isupper() else 1.0
                    yield i, j, "word", math.log10(rank) + extra
            if m := _DATE.match(value, i):
                yield i, m.end(), "date", math.log10(365 * 60) if m.end() - i > 4 else math.log10(60)
            for walk in self.walks:
                at = walk.find(low[i : i + 3]) if i + 3 <= n else -1
                if at >= 0:
                    k = 3
                    while i + k < n and at + k < len(walk) and walk[at + k] == low[i + k]:
                        k += 1
                    yield i, i + k, "walk", math.log10(10 * len(self.walks) * k)
            for unit, same in enumerate(periods, 1):
                times = 1 + same[i] // unit
                if times >= (3 if unit == 1 else 2):
                    text = value[i : i + unit]
                    if text not in prices:
                        prices[text] = self.brute(text) * unit
                    yield i, i + times * unit, "repeat", prices[text] + math.log10(times)

    @staticmethod
    def period(value: str, unit: int) -> list[int]:
        """For each place, how many characters from there on equal those ``unit`` further on."""
        out = [0] * (len(value) + 1)
        for i in range(len(value) - unit - 1, -1, -1):
            out[i] = out[i + 1] + 1 if value[i] == value[i + unit] else 0
        return out

    def __call__(self, value: str) -> float:
        """The least cost, in steps linear in the length: patterns from one place are bounded in number."""
        n = len(value)
        if not n:
            return 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, _, cost in self.segments(value):
            ends[j].append((i, cost))
        each = self.brute(value)
        best = [0.0] + [math.inf] * n  # least cost of a prefix
        open_ = [math.inf] * (n + 1)  # least cost of a prefix that ends in a brute-force span
        for j in range(1, n + 1):
            open_[j] = min(open_[j - 1], best[j - 1] + (self.STEP if j > 1 else 0.0)) + each
            best[j] = open_[j]
            for i, cost in ends[j]:
                best[j] = min(best[j], best[i] + cost + (self.STEP if i else 0.0))
        return best[n]


def cued(text: str) -> bool:
    """Whether a text holds a word that ASSIGN or CONTEXT starts with; lower() only adds hits."""
    low = text.lower()
    return any(cue in low for cue in CUES)


def base_spans(text: str) -> tuple[list, list, list]:
    """(start, end) lists of assign, access and hex spans."""
    assign = [] if not cued(text) else [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    access = [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return assign, access, [m.span() for m in HEX.finditer(text)]


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    """Spans (start, kind number, end) as ``kind:start:end``, by start and then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(text: str, cost: GuessCost, least: float = MIN_LOG10_GUESSES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float | None]:
    """Base spans, spans of the cost model, and the cost of the dearest value."""
    base = [(s, k, e) for k, found in enumerate(base_spans(text)) for s, e in found]
    more, top = [], None
    for m in CONTEXT.finditer(text) if cued(text) else ():
        value = m[1].rstrip(".!?:")
        if len(value) >= MIN_VALUE_CHARS:
            price = cost(value)
            top = price if top is None else max(top, price)
            if price >= least:
                more.append((m.start(1), 3, m.start(1) + len(value)))
    return base, more, top


FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("max_log10_guesses", T.DoubleType())]
)


def frequent_words(docs: DataFrame, most: int = DICTIONARY, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The words (three letters or more, in lower case) that most documents hold, most frequent first.

    What stands as a value in a credential context is not counted, so that a secret never enters
    the dictionary by being leaked often. Few partitions choose the words, as each one sends
    ``most`` words to the driver.
    """
    context = CONTEXT.pattern.replace(r"(?u:\w)", r"[\p{L}\p{N}_]")
    prose = F.lower(F.regexp_replace(whole_text(), F.lit("(?i)" + context), F.lit(" ")))
    found = F.regexp_extract_all(prose, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,32}(?![\p{L}\p{N}_])"), F.lit(0))
    counts = docs.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counts.where(F.col("n") >= least).repartition(8).orderBy(F.desc("n"), "word").limit(most).collect()]


def find_secrets(docs: DataFrame, words: Iterable[str] = WORDS, least: float = MIN_LOG10_GUESSES) -> DataFrame:
    """One row per document with its secret spans; null texts are empty, repeated rows stay.

    ``spans`` lists base spans and ``guess`` spans; offsets are code points.
    """
    words = tuple(words)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs))  # bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words, shared.value)
        for batch in batches:
            rows: list[list] = [[] for _ in FOUND]
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, more, top = scan(text, cost, least)
                n = [0, 0, 0, len(more)]
                for _, k, _ in base:
                    n[k] += 1
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                for col, v in zip(rows, (d, *n, sha, joined(base + more), top), strict=True):
                    col.append(v)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=FOUND.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, FOUND)


MASK = "[SECRET]"


def redact_secrets(docs: DataFrame, words: Iterable[str] = WORDS, least: float = MIN_LOG10_GUESSES, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret span replaced by ``mask`` (overlapping spans by one mask).

    All columns stay; ``n_chars``, if there is one, follows the new text. A null text stays null.
    """
    words, schema = tuple(words), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs))  # bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words, shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base, more, _ = scan(text, cost, least)
                    if base or more:
                        text = redacted(text, base + more, mask)
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    got = docs.mapInArrow(run, schema)
    return got.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else got


def redacted(text: str, spans: Iterable[tuple[int, int, int]], mask: str = MASK) -> str:
    """``text`` with the union of the spans masked."""
    out, at, end = [], 0, -1
    for s, _, e in sorted(spans):
        if s >= end:
            out += [text[at:s], mask]
            end = e
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]
