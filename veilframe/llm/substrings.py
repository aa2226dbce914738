"""Removal of repeated 50-byte strings by a logarithmic family of suffix arrays.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Strings are
sampled by minimisers: of the 27 runs of 24 bytes in a 50-byte string, the one with the least hash
is its anchor. Equal strings have equal anchors at equal places, so it is enough to compare what
lies around equal anchors, and every string belongs to exactly one anchor occurrence.

1. Anchor hashes are dealt out; those that occur in two documents come back as places.
2. Around such places the *stretch* of an anchor (all strings that it stands for) is cut out and
   dealt out by anchor hash. There, documents come in order of id ranges. Each range's stretches
   get a suffix array (sorted, each with its least document), which is merge-scanned against the
   levels of earlier ranges; then it becomes a level itself, and levels of like size merge.
3. The spans found are united per document, and the rest of the text is kept.

Before each shuffle, equal anchors or stretches of a batch are reduced to one, so a passage that
every document shares costs one entry a batch.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stash, whole_text

LENGTH = 50
GRAM = 24
CHOICE = LENGTH - GRAM + 1
#: Bytes of text that a Python worker takes together.
BATCH_BYTES = 4_000_000
#: Bytes of input for each bucket of anchors, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 24_000_000, 16
#: Id ranges that come in order, of about as many documents each (quantiles to this error).
RANGES, RANGE_ERROR = 8, 0.01
_U64 = np.uint64
_STRETCH = CHOICE + LENGTH - 1
_OUT = "bucket int, part int, doc_id long, variant long, blob binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Anchor occurrences of texts in one buffer: text number, first string, strings, place, hash.

    Places count from the start of the text.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH or not (sizes >= LENGTH).any():
        return empty, empty, empty, empty, np.zeros(0, _U64)
    h, width, base = _BYTE[data], 1, _U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while width < 16:
            h8 = h if width == 8 else None
            h = h[:-width] * base + h[width:]
            base, width = base * base, width * 2
            if h8 is not None:
                eight, base8 = h8, _U64(pow(0x9E3779B97F4A7C15, 8, 1 << 64))
        n = len(data) - GRAM + 1
        h = _mix(h[:n] * base8 + eight[16 : 16 + n])
    key = (h & _U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U64)
    width = 1
    while width * 2 <= CHOICE:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    last = CHOICE - width
    key = np.minimum(key[:-last], key[last:]) if last else key
    place = (key & _U64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(place) + 1, np.int32)
    long_ = sizes >= LENGTH
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, starts[long_] + sizes[long_] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    place = place[at]
    new = np.append(True, (place[1:] != place[:-1]) | (np.searchsorted(starts, at[1:], "right") != np.searchsorted(starts, at[:-1], "right")))
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(at)))
    first, place = at[run], place[run]
    doc = np.searchsorted(starts, first, "right") - 1
    return doc, first - starts[doc], count, place - starts[doc], h[place]


def _buffer(texts: list[bytes]):
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH_BYTES`` of the text column."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["bucket", "part", "doc_id", "variant", "blob"])


def _by_doc(doc: np.ndarray, variant: np.ndarray, *values: np.ndarray, spread: int) -> Iterator[tuple]:
    """Rows that carry values (32 bits each, side by side) straight to their documents.

    They pass the buckets untouched.
    """
    table = np.stack(values, 1).astype(np.uint32)
    order = np.lexsort((variant, doc))
    cut = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(variant[order]) != 0)) + 1
    for k in np.split(order, cut):
        if len(k):
            d = int(doc[k[0]])
            yield d % spread, -1, d, int(variant[k[0]]), table[k].tobytes()


def _deal_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 2):
            ids, variants = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            doc, _, _, place, h = anchors(*_buffer(batch.column(2).to_pylist()))
            if not len(doc):
                continue
            variant, doc = variants[doc], ids[doc]
            order = np.lexsort((doc, h))
            doc, variant, place, h = doc[order], variant[order], place[order], h[order]
            group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(first[1:], len(h)) - 1
            shared = doc[first] != doc[ends]  # two documents of this batch have it
            rows = list(_by_doc(doc[shared[group]], variant[shared[group]], place[shared[group]].astype(np.uint32), spread=buckets))
            send = ~shared[group]
            send[first] = True
            flag = shared[group][send]
            doc, variant, place, h = doc[send], variant[send], place[send].astype(np.uint32), h[send]
            bucket = (h % _U64(buckets)).astype(np.int64)
            order = np.lexsort((place, doc, bucket))
            for k in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                high = h[k].view(np.uint8).reshape(-1, 8)[:, 2:].copy()
                rows.append((int(bucket[k[0]]), 0, None, None, _pack(high, doc[k], variant[k], place[k], flag[k])))
            yield _rows(rows)

    return run


def _shared_anchors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the places of anchors that two documents have; rows come by bucket."""

    def found(blobs: list[bytes]) -> Iterator[tuple]:
        high, doc, variant, place, flag = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        h = np.zeros((len(high), 8), np.uint8)
        h[:, :6] = high
        h = h.view(_U64).ravel()
        order = np.argsort(h, kind="stable")
        h, doc, variant, place, flag = h[order], doc[order], variant[order], place[order], flag[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        ok = np.repeat(several | (np.add.reduceat(flag.astype(np.int64), first) > 0), size) & ~flag
        yield from _by_doc(doc[ok], variant[ok], place[ok], spread=1)

    yield from _per_bucket(rows, found)


def _per_bucket(rows: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    now, blobs = None, []
    for batch in rows:
        out = []
        for bucket, part, doc, variant, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                out.append((bucket, part, doc, variant, blob))
                continue
            if bucket != now:
                if blobs:
                    out += found(blobs)
                now, blobs = bucket, []
            blobs.append(blob)
        yield _rows(out)
    if blobs:
        yield _rows(list(found(blobs)))


def _stretches(data: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches as fixed-width strings. Bytes go up by one, as UTF-8 has no 255 and 0 pads."""
    col = np.arange(_STRETCH)
    place = np.minimum(at[:, None] + col, len(data) - 1)
    cells = np.where(col < (count + LENGTH - 1)[:, None], data[place] + np.uint8(1), np.uint8(0))
    return np.ascontiguousarray(cells).view(f"S{_STRETCH}").ravel()


def _deal_stretches(buckets: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 2):
            ids, variants = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, starts, sizes = _buffer(batch.column(2).to_pylist())
            doc, first, count, place, h = anchors(data, starts, sizes)
            wanted = [np.frombuffer(b"".join(blobs), np.uint32).astype(np.int64) + s for blobs, s in zip(batch.column(3).to_pylist(), starts, strict=True)]
            ok = np.isin(place + starts[doc], np.concatenate(wanted)) if len(doc) else np.zeros(0, bool)
            if not ok.any():
                continue
            doc, first, count, h = doc[ok], first[ok], count[ok], h[ok]
            text = _stretches(data, first + starts[doc], count)
            variant, doc = variants[doc], ids[doc]
            order = np.lexsort((doc, text))
            doc, variant, first, count, h, text = (x[order] for x in (doc, variant, first, count, h, text))
            new = np.append(True, text[1:] != text[:-1])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            over = doc != least  # a smaller document of this batch has all of it
            end = first + count + LENGTH - 1
            rows = list(_by_doc(doc[over], variant[over], first[over].astype(np.uint32), end[over].astype(np.uint32), spread=buckets))
            doc, variant, first, count, h, text = (x[~over] for x in (doc, variant, first, count, h, text))
            bucket = (h % _U64(buckets)).astype(np.int64)
            part = np.searchsorted(bounds, doc, "right")
            code = bucket * RANGES + part
            order = np.argsort(code, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                k = k[np.argsort(doc[k], kind="stable")]  # documents in a row pack well
                short = (h[k] >> _U64(32)).astype(np.uint32)  # narrows candidates; strings are compared
                rows.append((int(bucket[k[0]]), int(part[k[0]]), None, None, _pack(short, doc[k], variant[k], first[k].astype(np.uint32), count[k].astype(np.uint8), text[k])))
            yield _rows(rows)

    return run


class Family:
    """Levels of suffix arrays: stretches in order of anchor and text, with their least document."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, h, text, count, doc) -> None:
        """Adds a sorted array of distinct stretches and merges levels while they are alike in size."""
        level = (h, text, count, doc)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            other = self.levels.pop()
            both = [np.concatenate(x) for x in zip(other, level, strict=True)]
            order = np.lexsort((both[3], both[1], both[0]))
            both = [x[order] for x in both]
            new = np.append(True, (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1]))
            level = tuple(x[new] for x in both)
        self.levels.append(level)

    def meet(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All entries of the levels whose anchor is among ``h`` (sorted, distinct)."""
        got = []
        for level in self.levels:
            a, b = np.searchsorted(level[0], h), np.searchsorted(level[0], h, "right")
            n = b - a
            k = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            got.append([x[k] for x in level])
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint32), np.zeros(0, f"S{_STRETCH}"), np.zeros(0, np.int64), np.zeros(0, np.int64))


def scan(family: Family, h, text, count, doc, variant, first):
    """Spans (doc, variant, start, end) that smaller documents repeat, for the stretches of one id range.

    ``family`` holds the ranges before; the stretches of this one join it afterwards.
    """
    order = np.lexsort((doc, text, h))
    h, text, count, doc, variant, first = (x[order] for x in (h, text, count, doc, variant, first))
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
    head = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    old = family.meet(np.unique(h))
    # Whole stretches: all but the least document's, and all that an earlier range has.
    pair = np.concatenate([h[head], old[0]]), np.concatenate([text[head], old[1]])
    rank = np.lexsort((np.repeat([1, 0], [len(head), len(old[0])]), pair[1], pair[0]))
    same = np.append(False, (pair[0][rank][1:] == pair[0][rank][:-1]) & (pair[1][rank][1:] == pair[1][rank][:-1]))
    seen = np.zeros(len(head), bool)
    seen[rank[same & (rank < len(head))]] = True
    whole = seen[own] | (doc != doc[head][own])
    spans = [(doc[whole], variant[whole], first[whole], first[whole] + count[whole] + LENGTH - 1)]
    # Parts of stretches: strings that other stretches of the anchor have.
    lone = head[~seen]
    names, times = np.unique(np.concatenate([h[head], old[0]]), return_counts=True)
    lone = lone[times[np.searchsorted(names, h[lone])] > 1]
    if len(lone):
        among = np.unique(h[lone])
        group = np.flatnonzero(np.isin(h[head], among))
        mine = head[group]
        theirs = np.isin(old[0], among)
        t = np.concatenate([text[mine], old[1][theirs]])
        c = np.concatenate([count[mine], old[2][theirs]])
        d = np.concatenate([doc[mine], old[3][theirs]])
        source = np.repeat(np.arange(len(t)), c)
        shift = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        cells = t.view(np.uint8).reshape(len(t), _STRETCH)
        strings = np.lib.stride_tricks.sliding_window_view(cells, LENGTH, 1)[source, shift]
        strings = np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()
        order = np.lexsort((d[source], strings))
        s = strings[order]
        new = np.append(True, s[1:] != s[:-1])
        least = d[source][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.zeros(len(s), bool)
        hit[order] = least < d[source][order]
        hit &= source < len(mine)
        # The least document may have its stretch at several places, and all of them lose the string.
        rest = np.flatnonzero(~whole)
        found = group[source[hit]]
        a = np.searchsorted(own[rest], found)
        n = np.searchsorted(own[rest], found, "right") - a
        k = rest[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        at = first[k] + np.repeat(shift[hit], n)
        spans.append((doc[k], variant[k], at, at + LENGTH))
    family.add(h[head], text[head], count[head], doc[head])
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def _spans(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans per document; rows come by bucket and id range."""

    def flush(family: Family, blobs: list[bytes]) -> Iterator[tuple]:
        h, doc, variant, first, count, text = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        d, v, a, b = scan(family, h, text, count.astype(np.int64), doc, variant, first.astype(np.int64))
        yield from _by_doc(d, v, a.astype(np.uint32), b.astype(np.uint32), spread=1)

    now, blobs, family = None, [], Family()
    for batch in rows:
        out = []
        for bucket, part, doc, variant, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                out.append((bucket, part, doc, variant, blob))
                continue
            if (bucket, part) != now:
                if blobs:
                    out += flush(family, blobs)
                if now is None or bucket != now[0]:
                    family = Family()
                now, blobs = (bucket, part), []
            blobs.append(blob)
        yield _rows(out)
    if blobs:
        yield _rows(list(flush(family, blobs)))


def united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as maximal runs in order."""
    out: list[list[int]] = []
    for k in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[k]), int(ends[k])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def raw_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and the text's bytes. No alias where none is needed: exchanges must look alike to be reused."""
    doc_id = F.col("doc_id")
    if docs.schema["doc_id"].dataType.typeName() != "long":
        doc_id = doc_id.cast("long").alias("doc_id")
    return docs.select(doc_id, F.encode(whole_text(), "UTF-8").alias("raw"))


def _variant(several: DataFrame | None, total: Column) -> Column:
    """0, but for ids of several texts a number made of the text's MD5, below 2 to the power 60."""
    return F.when(F.col("several"), F.conv(F.substring(total, 1, 15), 16, 10).cast("long")).otherwise(F.lit(0).cast("long")) if several is not None else F.lit(0).cast("long")


def named_texts(docs: DataFrame, several: DataFrame | None) -> DataFrame:
    """doc_id, variant and raw of the rows with an id."""
    texts = raw_texts(docs).where("doc_id is not null")
    if several is not None:
        texts = texts.join(several.hint("merge"), "doc_id", "left")
    return texts.select("doc_id", _variant(several, F.md5("raw")).alias("variant"), "raw")


def by_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` joined with ``right`` by id and variant.

    Both are dealt by the id alone, so that one exchange of the texts serves all joins; hence no
    plain equality of variants.
    """
    right = right.withColumnsRenamed({"doc_id": "its_id", "variant": "its_variant"})
    same = (F.col("doc_id") == F.col("its_id")) & (F.col("variant") - F.col("its_variant") == 0)
    return left.join(right.hint("merge"), same, how).drop("its_id", "its_variant")


def whole_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, variant, copy (true) of the texts that a smaller document has whole; ids of several texts, if any."""
    sums = stash(raw_texts(docs).where("doc_id is not null").select("doc_id", F.md5("raw").alias("sum"), (F.octet_length("raw") >= LENGTH).alias("long")))
    several = stash(sums.groupBy("doc_id").agg(F.min("sum").alias("a"), F.max("sum").alias("z")).where("a < z").select("doc_id", F.lit(True).alias("several")))
    several = None if several.isEmpty() else several
    first = stash(sums.where("long").groupBy("sum").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last"))
    # One text may have most of the rows.
    copies = spread_join(sums.where("long").drop("long"), first, ["sum"], "n").where("doc_id > first")
    if several is not None:
        copies = copies.join(several, "doc_id", "left")
    copies = copies.select("doc_id", _variant(several, F.col("sum")).alias("variant"))
    return stash(copies.groupBy("doc_id", "variant").agg(F.lit(True).alias("copy"))), several


def _gathered(parts: DataFrame, name: str) -> DataFrame:
    """The blobs of each text, dealt by id."""
    return parts.repartition("doc_id").groupBy("doc_id", "variant").agg(F.collect_list("blob").alias(name))


def repeated_spans(docs: DataFrame, copies: DataFrame, several: DataFrame | None) -> DataFrame:
    """doc_id, variant and blobs of spans, for the texts that have any; ``copies`` stay out."""
    usable = named_texts(docs, several)
    plain = by_text(usable, copies, "left").where("copy is null").select("doc_id", "variant", "raw")
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    total, bounds = docs.select(F.sum(F.octet_length("text")), F.percentile_approx(F.col("doc_id").cast("long"), shares, F.lit(int(1 / RANGE_ERROR)))).first()
    buckets = max(LEAST_BUCKETS, int(total or 0) // BUCKET_BYTES)
    dealt = plain.mapInArrow(_deal_anchors(buckets), _OUT).repartition(buckets, "bucket").sortWithinPartitions("bucket", "part")
    places = _gathered(dealt.mapInArrow(_shared_anchors, _OUT), "places")
    around = by_text(usable, places, "inner").select("doc_id", "variant", "raw", "places")
    dealt = around.mapInArrow(_deal_stretches(buckets, sorted(bounds or [])), _OUT).repartition(buckets, "bucket").sortWithinPartitions("bucket", "part")
    return _gathered(dealt.mapInArrow(_spans, _OUT), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row of ``docs``.

    A null text is empty. Rows without an id take no part and keep all. Rows that repeat an id,
    with the same text or another, are documents of their own, none smaller than the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, n_spans, sha, kept = [], [], [], []
            for raw, blobs, copy in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                runs = [(0, len(raw))] if copy else united(*np.frombuffer(b"".join(blobs), np.uint32).reshape(-1, 2).T) if blobs else []
                at, parts = 0, []
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                rest = b"".join([*parts, raw[at:]])
                n_removed.append(len(raw) - len(rest))
                n_spans.append(len(runs))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    texts = raw_texts(docs)
    copies, several = whole_copies(docs)
    spans = repeated_spans(docs, copies, several)
    # All joins deal the same texts by id, so one exchange serves them.
    named = by_text(by_text(named_texts(docs, several), spans, "left"), copies, "left").select("doc_id", "raw", "spans", "copy")
    nameless = texts.where("doc_id is null").select("doc_id", "raw", F.lit(None).cast("array<binary>").alias("spans"), F.lit(None).cast("boolean").alias("copy"))
    joined = named.unionByName(nameless)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
