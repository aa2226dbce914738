"""Phrase collocations, counted by Rabin-Karp fingerprints of word n-grams.

Texts are read as bytes. Prefix polynomials over the bytes give every word a fingerprint, and
prefix polynomials over the words every n-gram; all of it in numpy, a megabyte at a time. Tasks
add up equal fingerprints, a shuffle adds up what tasks found, and each fingerprint carries a
second one from another field and a pointer to a text that has it. Only of frequent fingerprints
the phrase is read from the text pointed at. A fingerprint whose second fingerprints or texts
differ is counted again by text, so results never rest on fingerprints alone.

Longer n-grams are looked at only where the shorter ones inside are frequent: single words, then
pairs of frequent words, then runs of frequent pairs. That test is a bitmap of fixed size, which
may let too much through but never too little.

Edge cases: null and empty texts have no words; a null ``lang`` (or none) is ``und``; equal rows
count each; a word or text may be of any length; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, stash

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of the test for frequent fingerprints: 8 MB, at any number of phrases.
FILTER_BITS = 1 << 26
#: Pointers to texts are broadcast up to this many phrases, beyond that joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text that are hashed together; a longer word is taken whole.
SLICE = 1 << 19
#: Fingerprints that a task gathers before it adds up equal ones, and gives them away if still so many.
GATHER = 1 << 21

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PRIME = (1 << 31) - 1
_BASE2, _WORD_BASE2 = 1_103_515_245, 48_271
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

#: Bits of a fingerprint, and of each half of a mark: the second fingerprint above, the hash of a
#: text that has the phrase below. Bytes that are always zero cost nothing in a compressed shuffle.
BITS, HALF = 56, 24
COUNTED = "fp long, c long, mark long"
NAMED = "n byte, fp long, lang string, phrase string, c long"


class Powers:
    """Powers of a base and of its inverse: modulo 2**64, or modulo a prime below 2**31."""

    def __init__(self, base: int, prime: int = 0):
        self.prime = prime
        self.bases = base, pow(base, -1, prime or 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([p, self._times(p, np.uint64(pow(b, k, self.prime or 1 << 64)))]) for p, b in zip((self.up, self.down), self.bases, strict=True))
        return self.up[:n], self.down[:n]

    def _times(self, a, b):
        return a * b % np.uint64(self.prime) if self.prime else a * b

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of each span of ``values``, by differences of prefix sums."""
        up, down = self.to(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(self._times(values, up[:-1]), out=sums[1:])
        if self.prime:
            sums %= np.uint64(self.prime)
            return self._times((sums[end] + np.uint64(self.prime) - sums[start]) % np.uint64(self.prime), down[start])
        return (sums[end] - sums[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values, scattered one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words in order: fingerprints, number of their piece, number of their text, where they lie."""

    one: np.ndarray
    two: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    known: int = 0  # so many at the front were in the run before

    def last(self, n: int) -> Words:
        cut = slice(max(0, len(self.one) - n), None)
        return Words(self.one[cut], self.two[cut], self.piece[cut], self.text[cut], self.start[cut], self.end[cut])

    def after(self, before: Words) -> Words:
        both = [np.concatenate([getattr(w, f) for w in (before, self)]) for f in ("one", "two", "piece", "text", "start", "end")]
        return Words(*both, known=len(before.one))


class Grams:
    """Fingerprints of n-grams. ``bits`` keeps only so many of them, for tests of collisions."""

    def __init__(self, longest: int, bits: int = BITS):
        self.longest, self.mask = longest, np.uint64((1 << bits) - 1)
        self.bytes = Powers(_BASE), Powers(_BASE2, _PRIME)
        self.words = Powers(_WORD_BASE), Powers(_WORD_BASE2, _PRIME)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Words]:
        """Words of the texts that lie end to end in ``data``, in runs; long texts take several."""
        at, stop, pieces, before = int(offsets[0]), int(offsets[-1]), 0, None
        while at < stop:
            end, inside = self._cut(data, offsets, at, stop)
            part = data[at:end]
            kind = _KIND[part]
            fresh = np.zeros(len(part) + 1, bool)
            fresh[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at] = True
            fresh = fresh[:-1]
            letter = kind == 0
            first, last = letter.copy(), letter.copy()
            first[1:] &= ~letter[:-1] | fresh[1:]
            last[:-1] &= ~letter[1:] | fresh[1:]
            start, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            piece = np.cumsum((kind == 2) | fresh, dtype=np.int64) + pieces
            pieces = int(piece[-1])
            value = (_LOWER[part].astype(np.uint64)) + np.uint64(1)
            one, two = (p.spans(value, start, ends) for p in self.bytes)
            one = mixed(one + (ends - start).astype(np.uint64) * np.uint64(_WORD_BASE))
            words = Words(one, two, piece[start], np.searchsorted(offsets, start + at, "right") - 1, start + at, ends + at)
            if before is not None:
                words = words.after(before)
            yield words
            before = words.last(self.longest - 1) if inside else None
            at = end

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, at: int, stop: int) -> tuple[int, bool]:
        """Where a run of about ``SLICE`` bytes ends, and whether that is inside a text."""
        if at + SLICE >= stop:
            return stop, False
        k = np.searchsorted(offsets, at + SLICE, "right") - 1
        if offsets[k] > at:
            return int(offsets[k]), False
        end = int(offsets[k + 1]) if offsets[k] == at or k + 1 < len(offsets) else stop
        gaps = np.flatnonzero(_KIND[data[at : at + SLICE]])
        if len(gaps) and gaps[-1]:
            return at + int(gaps[-1]), True
        low = at + SLICE
        while low < end:  # one word of more than a slice
            gaps = np.flatnonzero(_KIND[data[low : min(end, low + SLICE)]])
            if len(gaps):
                return low + int(gaps[0]), True
            low += SLICE
        return end, False

    def of(self, words: Words, n: int, at: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both fingerprints of the n-grams that begin at the words ``at``; ``lang`` by text."""
        one, two = (p.spans(v, at, at + n) for p, v in zip(self.words, (words.one, words.two), strict=True))
        return mixed(one + lang[words.text[at]] + np.uint64(n)) & self.mask, two

    def places(self, words: Words, n: int) -> np.ndarray:
        """Words at which an n-gram begins that lies in one piece and was not in the run before."""
        at = np.arange(max(0, words.known - n + 1), len(words.one) - n + 1)
        return at[words.piece[at] == words.piece[at + n - 1]] if n > 1 else at


def lang_values(langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each language."""
    raw = [x.encode("utf-8", "surrogatepass") for x in langs]
    one = np.array([zlib.crc32(r) << 32 | zlib.crc32(r, 1) for r in raw], np.uint64)
    return mixed(one), np.array([zlib.adler32(r) % _PRIME for r in raw], np.uint64)


def buffers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binary values without nulls."""
    cells = cells.cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    data = cells.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def passes(kept: np.ndarray, fp: np.ndarray) -> np.ndarray:
    bit = fp & np.uint64(FILTER_BITS - 1)
    return (kept[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


class Tally:
    """Fingerprints gathered in a task, with equal ones added up."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, fp: np.ndarray, fp2: np.ndarray, doc: np.ndarray, c: np.ndarray | None = None) -> None:
        if len(fp):
            self.parts.append([fp, np.ones(len(fp), np.int64) if c is None else c, (fp2.astype(np.int64) & (1 << HALF) - 1) << HALF | doc])
            self.size += len(fp)

    def summed(self) -> pa.RecordBatch:
        fp, c, mark = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(fp, kind="stable")
        fp, c, mark = (x[order] for x in (fp, c, mark))
        new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (mark[1:] >> HALF != mark[:-1] >> HALF)]))
        fp, c, mark = fp[new], np.add.reduceat(c, new), mark[new]
        self.parts, self.size = [[fp, c, mark]], len(new)
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(c), pa.array(mark)], names=["fp", "c", "mark"])

    def give(self) -> Iterator[pa.RecordBatch]:
        """All of it, if it is still long once added up."""
        if self.size > GATHER:
            batch = self.summed()
            if self.size > GATHER // 2:
                yield batch
                self.parts, self.size = [], 0


def texts_of(docs: DataFrame) -> DataFrame:
    """text (bytes), lang and ``doc``, bits of a hash of both, of every row."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.encode(text, "UTF-8").alias("text"), lang.alias("lang"), F.xxhash64(lang, text).bitwiseAND(F.lit((1 << HALF) - 1).cast("long")).alias("doc"))


def count(texts: DataFrame, sizes: tuple[int, ...], kept, least: int, bits: int) -> DataFrame:
    """fp, c, low, high (least and greatest mark) of the fingerprints of n-grams that occur ``least`` times.

    ``kept`` (n, broadcast bitmap): all n-grams of that length in a longer one must pass it. With
    size 1 every language counts as a phrase of no words that occurs as often as its words.
    A mark is 8 bytes, as the rows of rare n-grams are most of what is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tally = Grams(LONGEST, bits), Tally()
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(0))
            lang, lang2 = lang_values(batch.column(1).to_pylist())
            doc = batch.column(2).to_numpy()
            for words in grams.runs(data, offsets):
                if kept is not None:
                    base = grams.places(Words(words.one, words.two, words.piece, words.text, words.start, words.end), kept[0])
                    good = np.zeros(len(words.one) + 1, bool)
                    good[base] = passes(kept[1].value, grams.of(words, kept[0], base, lang)[0])
                for n in sizes:
                    at = grams.places(words, n)
                    if kept is not None:
                        for k in range(n - kept[0] + 1):
                            at = at[good[at + k]]
                    if n == 1:
                        seen = np.bincount(words.text[at], minlength=len(doc))
                        some = np.flatnonzero(seen)
                        tally.add(lang[some] & grams.mask, lang2[some], doc[some], seen[some])
                    tally.add(*grams.of(words, n, at, lang), doc[words.text[at]])
                yield from tally.give()
        if tally.parts:
            yield tally.summed()

    # Tasks have added up what is equal, so nothing is gained by doing it again before the shuffle.
    found = texts.mapInArrow(run, COUNTED).repartition("fp").groupBy("fp").agg(F.sum("c").alias("c"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    return found.where(F.col("c") >= least)


def bitmap(found: DataFrame) -> np.ndarray:
    """The bits of all ``fp``, in a bitmap of fixed size; its words are what the driver gets."""
    word = F.expr(f"cast((fp & {FILTER_BITS - 1}L) div 64 as int)").alias("word")
    got = found.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(fp & 63L as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _phrases(grams: Grams, batch: pa.RecordBatch, wanted) -> Iterator[tuple]:
    """n, fp, lang, phrase, times of the n-grams for which ``wanted(n, fp, texts)`` holds."""
    data, offsets = buffers(batch.column(0))
    langs = batch.column(1).to_pylist()
    lang, _ = lang_values(langs)
    for words in grams.runs(data, offsets):
        one = grams.places(words, 1)
        text, seen = np.unique(words.text[one], return_counts=True)
        ok = wanted(0, lang[text] & grams.mask, text)
        for t, c, fp in zip(text[ok].tolist(), seen[ok].tolist(), (lang[text] & grams.mask)[ok].view(np.int64).tolist(), strict=True):
            yield 0, fp, langs[t], "", c
        for n in range(1, grams.longest + 1):
            at = grams.places(words, n)
            fp, _ = grams.of(words, n, at, lang)
            ok = wanted(n, fp, words.text[at])
            for i, x in zip(at[ok].tolist(), fp[ok].view(np.int64).tolist(), strict=True):
                spans = [_LOWER[data[words.start[k] : words.end[k]]].tobytes() for k in range(i, i + n)]
                yield n, x, langs[words.text[i]], b" ".join(spans).decode("utf-8", "replace"), 1


def _batch(rows: dict[tuple, int]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int8(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(rows.values()), pa.int64())], names=["n", "fp", "lang", "phrase", "c"])


def read_phrases(texts: DataFrame, found: DataFrame, rows: int, bits: int) -> DataFrame:
    """n, fp, lang, phrase: what each of ``rows`` fingerprints stands for in the texts it points at."""
    doc = lambda mark: F.col(mark).bitwiseAND(F.lit((1 << HALF) - 1).cast("long"))
    wanted = found.select("fp", F.explode(F.array(doc("low"), doc("high"))).alias("doc")).groupBy("doc").agg(F.collect_set("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(LONGEST, bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            fps = np.sort(batch.column(2).flatten().to_numpy().view(np.uint64) + mixed(own.astype(np.uint64) + np.uint64(1)))

            def listed(n, fp, text, fps=fps):  # by fingerprint and text at once
                key = fp + mixed(text.astype(np.uint64) + np.uint64(1))
                return fps[np.minimum(np.searchsorted(fps, key), len(fps) - 1)] == key

            yield _batch(dict.fromkeys((p[:4] for p in _phrases(grams, batch, listed)), 0))

    pointed = texts.join(F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted, "doc").select("text", "lang", "fps")
    return pointed.mapInArrow(run, NAMED).drop("c")


def recounted(texts: DataFrame, doubtful: DataFrame, least: int, bits: int) -> DataFrame:
    """lang, n, phrase, f of all phrases behind ``doubtful`` fingerprints, counted by text."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(doubtful))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(LONGEST, bits)
        for batch in batches:
            seen: dict[tuple, int] = {}
            for *key, c in _phrases(grams, batch, lambda n, fp, text: passes(shared.value, fp)):
                seen[tuple(key)] = seen.get(tuple(key), 0) + c
                if len(seen) > 200_000:
                    yield _batch(seen)
                    seen = {}
            yield _batch(seen)

    rows = texts.mapInArrow(run, NAMED).groupBy("n", "fp", "lang", "phrase").agg(F.sum("c").alias("f"))
    return rows.join(doubtful, "fp", "left_semi").where(F.col("f") >= least).select("lang", "n", "phrase", "f")


def frequent(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, n, phrase, f: phrases of 1 to ``LONGEST`` words with ``least`` occurrences, by language.

    The phrase of no words has all words of its language as f. The result is a written table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = texts_of(docs)
    levels = [scratch.write(count(texts, (1,), None, least, bits))]
    for n, sizes in ((1, (2,)), (2, tuple(range(3, LONGEST + 1)))):
        kept = spark.sparkContext.broadcast(bitmap(levels[-1]))
        levels.append(scratch.write(count(texts, sizes, (n, kept), least, bits)))
    found = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy("fp").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
    named = scratch.write(read_phrases(texts, found, found.count(), bits))
    what = F.struct("n", "lang", "phrase")
    sole = named.groupBy("fp").agg(F.min(what).alias("p"), F.max(what).alias("q"))
    joined = scratch.write(found.join(sole, "fp", "left"))
    sure = F.coalesce((F.shiftright("low", HALF) == F.shiftright("high", HALF)) & (F.col("p") == F.col("q")), F.lit(False))
    out = joined.where(sure).select("p.lang", F.col("p.n").cast("int").alias("n"), "p.phrase", F.col("c").alias("f"))
    doubtful = joined.where(~sure).select("fp")
    if not doubtful.isEmpty():
        out = out.unionByName(recounted(texts, doubtful, least, bits))
    out = stash(out)
    scratch.delete()
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to 5 words.

    a, l and r count the phrase and the two parts of its lowest-scoring cut (the first of equal
    ones), n the language's words; score is floor(1000 a n / (l r)), in whole numbers of up to 38
    digits. A phrase inside a longer one that occurs as often goes.
    """
    f = frequent(docs, least, bits)
    many = f.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    known = f.where("n >= 1").select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    total = f.where("n = 0").select("lang", F.col("f").alias("n"))  # a row for each language
    big = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(1000 as decimal(4,0)) * {big('a')} * {big('n')} div ({big('l')} * {big('r')})")
    scored = cuts.join(total, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = many.where(F.size("w") > 2).select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.size("w") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))))).alias("phrase")
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    open_ = lowest.join(covered, ["lang", "phrase"], "left").where("above is null or above < a")
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")


#: The rows of :func:`collocations` in DuckDB's SQL.
ORACLE = f"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, k as n, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from words, range(1, {LONGEST + 1}) as s(k) where len(w) >= k),
f as (select lang, n, phrase, count(*)::hugeint as f from grams group by all having count(*) >= {LEAST}),
total as (select lang, sum(len(w))::hugeint as n from words group by lang),
cuts as (
  select f.lang, f.phrase, f.f as a, k, t.n, l.f as l, r.f as r, (1000 * f.f * t.n) // (l.f * r.f) as score
  from f, range(1, {LONGEST}) as s(k), f as l, f as r, total as t
  where f.n >= 2 and k < f.n and t.lang = f.lang
    and l.lang = f.lang and l.n = k and l.phrase = array_to_string(string_split(f.phrase, ' ')[1:k], ' ')
    and r.lang = f.lang and r.n = f.n - k and r.phrase = array_to_string(string_split(f.phrase, ' ')[k + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select f.lang, f.f, array_to_string(string_split(f.phrase, ' ')[i:i + s - 1], ' ') as phrase
  from f, range(2, {LONGEST}) as a(s), range(1, {LONGEST}) as b(i) where s < f.n and i + s - 1 <= f.n),
left_ as (select * from lowest where not exists (select 1 from inner_ where inner_.lang = lowest.lang and inner_.phrase = lowest.phrase and inner_.f >= lowest.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from left_ qualify rank <= {TOP}
"""
