"""Best-fit packing of token sequences by planning over a histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Best-fit
decreasing then runs over *counts of lengths* (at most ``capacity`` of them, whatever the
corpus holds), which gives a plan of slots: ranks ``lo..hi`` of a length go to sequence
``first + t // per`` at a known offset. Each piece gets a rank within its length and takes
its slot by a join on length and rank, so no documents pass through the driver.
"""

from __future__ import annotations

import functools
import operator
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, whole_text

CAPACITY = 2048
#: A plan of at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Distinct words whose ids a Python worker keeps before it starts afresh.
CACHE_WORDS = 200_000
#: Characters of text whose words are looked up together.
CHUNK_CHARS = 2_000_000
#: Longer words go to the tokenizer one by one, as a merge in bulk takes time with the square of their length.
BULK_LETTERS = 64
#: Ranks of a length that meet a plan of many rows under one key.
RANK_BUCKET = 1 << 16
#: Separates the id blocks of documents: appended after each one.
END_ID = 0
_TAIL = ".,;:!?*#$%&|<>"
_LETTERS = re.compile("[%s]{1,%d}" % ("".join(c for c in map(chr, range(256)) if c.isalpha()), BULK_LETTERS))
#: Bits that hold the place of a pair in a word of ``BULK_LETTERS`` letters of two bytes.
_PLACE_BITS = (2 * BULK_LETTERS - 1).bit_length()

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class Merges:
    """The tokenizer's own merges, applied to many words at once.

    Words of one length form a matrix of symbols, a column each; each step merges the leftmost pair
    of least rank in every column that still has one, which is what the tokenizer does word by word.
    """

    def __init__(self, tokenizer):
        import json

        import numpy as np

        model = json.loads(tokenizer.to_str())["model"]
        vocab = model["vocab"]
        self.usable = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges")
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(kept)))}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + "</w>"] for b in range(256)], np.int32)
        self.width = len(vocab) + 2
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.none = len(pairs)
        self.inner_pairs, self.final_pairs = (self._ranks(self.inner[:, None], x[None]) for x in (self.inner, self.final))

    def takes(self, words: Iterable[str]) -> list[str]:
        """Of these, the words that are one run of letters of which the tokenizer's normaliser changes the case alone."""
        return list(filter(_LETTERS.fullmatch, words)) if self.usable else []

    def _ranks(self, left, right):
        import numpy as np

        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], np.int32(self.none))

    def __call__(self, words: list[str]) -> list[bytes]:
        """Ids of each word that :meth:`takes` let through."""
        import numpy as np

        out = np.empty(len(words), object)
        data = np.frombuffer("\n".join([*words, ""]).lower().encode(), np.uint8)
        ends = np.flatnonzero(data == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        order = np.argsort(sizes, kind="stable")
        for live in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if words else []:
            n = int(sizes[live[0]])
            text = data[(ends[live] - n)[None] + np.arange(n)[:, None]]
            ids = self.inner[text]
            ids[-1] = self.final[text[-1]]
            rank = self.inner_pairs[text[:-1], text[1:]]
            rank[-1:] = self.final_pairs[text[-2:-1], text[-1:]]
            while len(live):
                # Rank and place as one number: the least is the leftmost pair of least rank.
                best = (rank << _PLACE_BITS | np.arange(len(rank), dtype=np.int32)[:, None]).min(0) if len(rank) else np.full(len(live), self.none << _PLACE_BITS, np.int32)
                going = best < self.none << _PLACE_BITS
                if not going.all():
                    done = np.ascontiguousarray(ids[:, ~going].T, "<u4")
                    out[live[~going]] = np.frombuffer(done.tobytes(), f"V{4 * done.shape[1]}").tolist()
                    ids, rank, best, live = ids[:, going], rank[:, going], best[going], live[going]
                at, col = best & ((1 << _PLACE_BITS) - 1), np.arange(len(live))
                merged = self.made[best >> _PLACE_BITS]
                before = np.arange(len(rank), dtype=np.int32)[:, None] <= at
                ids = np.where(before, ids[:-1], ids[1:])
                ids[at, col] = merged
                rank = np.where(before[:-1], rank[:-1], rank[1:])
                for shift in (-1, 0):  # the pairs that the new symbol takes part in
                    k = at + shift
                    ok = np.flatnonzero((k >= 0) & (k < len(rank)))
                    k = k[ok]
                    rank[k, ok] = self._ranks(ids[k, ok], ids[k + 1, ok])
        return out.tolist()


class WordIds:
    """Token ids of texts as little-endian bytes, remembered word by word.

    The tokenizer drops white space and never joins across it, so the ids of a text are those
    of its words in turn; a letter run and the punctuation after it are likewise apart.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)
        self.limit = limit
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        import numpy as np

        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in got]

    def _learn(self, words: set[str]) -> None:
        known, plain = self.known, self.merges.takes(words)
        rest = list(words.difference(plain))
        stems = [s if s.isalpha() else w for s, w in zip([w.rstrip(_TAIL) for w in rest], rest, strict=True)]
        tails = [w[len(s) :] for s, w in zip(stems, rest, strict=True)]
        new = set(stems).union(tails).difference(known, plain)
        more = self.merges.takes(new)
        plain += more
        known.update(zip(plain, self.merges(plain), strict=True))
        odd = list(new.difference(more))
        known.update(zip(odd, self._encode(odd), strict=True))
        found = known.__getitem__
        known.update(zip(rest, list(map(operator.add, map(found, stems), map(found, tails))), strict=True))

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; unknown words are learnt for about ``CHUNK_CHARS`` of text at once."""
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and size < CHUNK_CHARS:
                text = texts[at]
                size += len(text)
                lists.append((text.lower() if text.isascii() else text).replace("\n", " ").split(" "))
                at += 1
            known = self.known
            if len(known) > self.limit:
                known.clear()
                known[""] = b""
            new = set().union(*lists).difference(known)
            if new:
                self._learn(new)
            for words in lists:
                yield b"".join(map(known.__getitem__, words))


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The one :class:`WordIds` of a Python worker, which its tasks use in turn."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A null text is empty and gives the end id alone. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            doc, number, start, length, crc = [], [], [], [], []
            for d, ids in zip(batch.column(0).to_pylist(), ids_of.many(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(d)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=PIECES.names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows are (length, lo, hi, first, per, base): item ``t = rank - lo`` of this length goes
    to sequence ``first + t // per`` at ``base + (t % per) * length``.
    """
    rooms: list[int] = []  # free space of open sequences, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # by free space: (first sequence, how many)
    rows, made = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    del rooms[at]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            per = room // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, capacity - room))
                keep(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left:  # fewer than per are left, for one more sequence
                    rows.append((length, rank, rank + left, first + full, per, capacity - room))
                    keep(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                keep(room, first + full, n - full)
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with a ``length`` column of 1 to capacity) plus sequence_id and offset.

    ``parts`` is checkpointed, as it is read for the histogram, for group sizes and for the
    result. A length that many parts share is dealt over salted groups, so that no task gets
    all of it; the number of groups follows the number of shuffle partitions.
    """
    spark = parts.sparkSession
    parts = cut(parts)
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    names = parts.columns
    if not counts:
        return parts.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = max(200, sum(counts.values()) // (4 * width))
    plan = spark.createDataFrame(
        plan_slots(counts, capacity), "p_length long, lo long, hi long, first long, per long, base long"
    )
    salts = spark.createDataFrame([(n, -(-c // group)) for n, c in counts.items()], "p_length long, groups long")
    salted = parts.join(F.broadcast(salts), parts["length"] == salts["p_length"]).drop("p_length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(*names), F.col("groups"))).drop("groups")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("length").alias("s_length"),
        F.col("salt").alias("s_salt"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*names))
    ranked = (
        salted.withColumn("local", local)
        .join(sizes, (F.col("length") == F.col("s_length")) & (F.col("salt") == F.col("s_salt")))
        .withColumn("rank", F.col("before") + F.col("local") - 1)
    )
    t = F.col("rank") - F.col("lo")
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    if plan_rows(plan) <= BROADCAST_ROWS:
        met = ranked.join(F.broadcast(plan), fits)
    else:  # by length and bucket of ranks, so that a length with most pieces is many keys
        bucket = lambda c: F.floor(c / RANK_BUCKET)
        buckets = plan.withColumn("p_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi") - 1))))
        met = ranked.join(buckets, fits & (bucket(F.col("rank")) == F.col("p_bucket")))
    return met.select(
        *names,
        (F.col("first") + F.floor(t / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(t, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def plan_rows(plan: DataFrame) -> int:
    """Rows of the plan, which the driver holds anyway."""
    return plan.count()


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as packed pieces: the columns of :func:`pieces`, sequence_id and offset."""
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
