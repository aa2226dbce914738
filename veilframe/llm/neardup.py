"""Near-duplicates by BagMinHash: signatures of weighted Jaccard, bands, and exact verification.

A document is the multiset of its five-word shingles; a shingle's weight is how often it occurs.
The weight axis is cut at 1, 2, 4, 8, ...; each (shingle, interval) has a Poisson process of its
own, whose points carry an arrival time, a signature slot and a height. A document keeps, for each
slot, the earliest point below its weights, so two documents agree on a slot with a probability
of exactly their weighted Jaccard similarity. Points are made in order of arrival and stop once
none can win, so a signature takes about n + m log m steps.

Bands of slots give buckets. In each bucket all members are first compared with the one that
shares most buckets, which links the copies of one text to each other. What is left are pairs of a
bucket that lie in different components: documents of which a fifth of the shingles occurs in no
other open document drop out, as they cannot have a partner, and the others are compared block
by block, each task counting the overlaps of two blocks at once and giving links only. So no pair
that shares a bucket is given up, and none becomes a row. What is compared are bags of hashes,
packed into blocks of documents that share their largest bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, spread_join, stash, whole_text
from .components import components
from .wordhash import WordRows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: A block of bags holds about so many documents, or shingles.
BLOCK, BLOCK_SHINGLES = 128, 100_000
#: Shingles that a task lines up at once to count overlaps.
COLUMNS = 20_000
#: Tables of ids up to so many rows are broadcast (16 bytes a row); longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of one key of a join that a task takes; more are dealt over salted copies.
KEY_ROWS = 10_000
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (constants of the splitmix64 finaliser)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), _U64, len(words))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle of all its words."""
    n = len(hashes)
    k = min(SHINGLE, n)
    if not n:
        return hashes
    out = np.zeros(n - k + 1, _U64)
    for j in range(k):
        out = _mix(out * _U64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j])
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` 64-bit values for each (shingles, counts); of zeros for an empty one."""
    best = np.full((len(bags), slots), np.inf)
    doc, gram, level, weight = [], [], [], []
    for d, (g, c) in enumerate(bags):
        for k in range(int(c.max()).bit_length() + 1 if len(c) else 0):
            reach = c > (0 if k == 0 else 1 << (k - 1))
            n = int(np.count_nonzero(reach))
            if not n:
                break
            doc.append(np.full(n, d))
            gram.append(g[reach])
            level.append(np.full(n, k))
            weight.append(c[reach])
    if doc:
        d, g, k, c = map(np.concatenate, (doc, gram, level, weight))
        low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0)).astype(float)
        width = np.where(k == 0, 1, low)
        state = _mix(g + _mix(k.astype(_U64) + _U64(1)))
        time = np.zeros(len(d))
        flat = best.reshape(-1)
        while len(d):
            state = state + _U64(0x9E3779B97F4A7C15)
            a = _mix(state)
            time = time - np.log(((a >> _U64(11)).astype(float) + 0.5) * 2.0**-53) / width
            b = _mix(a ^ _U64(0x5851F42D4C957F2D))
            slot = ((b >> _U64(32)) % _U64(slots)).astype(np.int64)
            height = low + ((b & _U64(0xFFFFFFFF)).astype(float) + 0.5) * 2.0**-32 * width
            ok = height < c
            np.minimum.at(flat, d[ok] * slots + slot[ok], time[ok])
            on = time < best.max(1)[d]
            d, c, low, width, state, time = d[on], c[on], low[on], width[on], state[on], time[on]
    best[np.isinf(best)] = 0
    return best.view(_U64)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(signature), BANDS), _U64) + np.arange(1, BANDS + 1, dtype=_U64)
    for r in range(ROWS):
        out = _mix(out * _U64(0x9E3779B97F4A7C15) + signature[:, r::ROWS])
    return out.view(np.int64)


def _bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes), return_counts=True)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (shingles) and bands of every whole text; no words, no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows(word_hashes)
        for batch in batches:
            sizes, names, keys = [], [], []
            for chunk in rows.chunks(batch.column(1).to_pylist()):
                hashes = [rows.rows[numbers] for numbers in chunk]
                bags = [_bag(h) for h in hashes]
                names += [xxhash.xxh128_hexdigest(h.tobytes()) for h in hashes]
                sizes += [int(c.sum()) for _, c in bags]
                got = bands_of(signatures(bags))
                keys += [k if len(b[0]) else k[:0] for k, b in zip(got, bags, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, text_hash string, n long, bands array<long>"
    )


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted items and counts)."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][i], two[1][j]).sum())
    whole = int(one[1].sum() + two[1].sum()) - both
    return both / whole if whole else 0.0


def bag_bytes(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag as its sorted 64-bit items, then their 32-bit counts."""
    return bag[0].tobytes() + bag[1].astype(np.int32).tobytes()


def bag_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, _U64, n), np.frombuffer(data, np.int32, n, 8 * n)


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` (block, node, text) as a row a block, with the bags of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows(word_hashes)
        for batch in batches:
            data = [bag_bytes(_bag(rows.rows[numbers])) for chunk in rows.chunks(batch.column(2).to_pylist()) for numbers in chunk]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["block", "node", "data"])

    bags = texts.select("block", "node", "text").mapInArrow(run, "block long, node long, data binary")
    return bags.groupBy("block").agg(F.collect_list(F.struct("node", "data")).alias("members"))


def similar(lists: DataFrame, least: float) -> DataFrame:
    """a, b, ok from rows of ``pairs`` and the packed blocks ``one`` and ``two`` that hold their bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pairs, *blocks = (c[k].as_py() for c in batch.columns)
                bags = {m["node"]: bag_of(m["data"]) for block in blocks for m in block or ()}
                ok = [similarity(bags[p["a"]], bags[p["b"]]) >= least for p in pairs]
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in "ab"] + [pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return lists.select("pairs", "one", "two").mapInArrow(run, "a long, b long, ok boolean")


def verified(pairs: DataFrame, packs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b, ok of pairs (a, b, block_a, block_b): whether the multisets of shingles are similar enough.

    Pairs of the same two blocks make one row.
    """
    swap = F.col("block_a") > F.col("block_b")
    lists = pairs.groupBy(F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y")).agg(
        F.collect_list(F.struct(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))).alias("pairs")
    )
    met = pairs.select(F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y")).distinct()
    return similar(with_blocks(lists, met, packs), least)


def with_blocks(rows: DataFrame, met: DataFrame, packs: DataFrame) -> DataFrame:
    """``rows`` (x, y, ...) with the members of their blocks as ``one`` and, if x and y differ, ``two``.

    ``met`` lists the distinct (x, y). A block that meets many others is dealt out in copies.
    """
    salts = {}
    for side in ("x", "y"):
        count = met.where("x <> y").groupBy(side).agg(F.count("*").alias("c"))
        salts[side] = count.where(F.col("c") > BLOCK).select(F.col(side), F.ceil(F.col("c") / BLOCK).alias("copies"))

    def joined(rows: DataFrame, side: str, name: str) -> DataFrame:
        other = "y" if side == "x" else "x"
        dealt = rows.join(salts[side], side, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1)))).drop("copies")
        copies = packs.select(F.col("block").alias(side), F.col("members").alias(name)).join(salts[side], side, "left")
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        return dealt.join(copies, [side, "salt"]).drop("salt")

    inside = rows.where("x = y").join(packs.select(F.col("block").alias("x"), F.col("members").alias("one")), "x")
    inside = inside.withColumn("two", F.lit(None).cast(packs.schema["members"].dataType))
    return inside.unionByName(joined(joined(rows.where("x <> y"), "x", "one"), "y", "two"))


def tokens_of(data: bytes) -> np.ndarray:
    """A bag as a set: the k-th repetition of a shingle is an item of its own."""
    items, counts = bag_of(data)
    again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)  # 0, 1, ... of each item
    return _mix(np.repeat(items, counts) + again.astype(_U64)).view(np.int64)


def repacked(packs: DataFrame, placed: DataFrame) -> DataFrame:
    """The documents of ``placed`` (node, comp, block) by their new blocks, with their bags as sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [tokens_of(d.as_py()).tobytes() for d in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["block", "node", "comp", "data"])

    bags = packs.select(F.explode("members").alias("m")).select("m.node", "m.data").join(few(placed.select("node", "comp", "block")), "node")
    sets = bags.select("block", "node", "comp", "data").mapInArrow(run, "block long, node long, comp long, data binary")
    return sets.groupBy("block").agg(F.collect_list(F.struct("node", "comp", "data")).alias("members"))


def shared_shingles(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, alone: how many shingles of each of ``nodes`` (with repetitions) no other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = tokens_of(data)
                for at in range(0, len(tokens), 100_000):
                    part = tokens[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(part)], names=["node", "token"])

    open_bags = packs.select(F.explode("members").alias("m")).select("m.node", "m.data").join(nodes, "node", "left_semi")
    tokens = open_bags.mapInArrow(run, "node long, token long")
    once = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    return once.groupBy("node").agg(F.count("*").alias("alone"))


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many items each of the sets ``one`` shares with each of ``two``."""
    sides = [(np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])) for sets in (one, two)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(one), len(two)), np.float64)
    for at in range(0, len(both), COLUMNS):
        part, tables = both[at : at + COLUMNS], []
        for (items, rows), sets in zip(sides, (one, two), strict=True):
            place = np.searchsorted(part, items)
            hit = part[np.minimum(place, len(part) - 1)] == items
            table = np.zeros((len(sets), len(part)), np.float32)
            table[rows[hit], place[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def block_links(rows: DataFrame, least: float) -> DataFrame:
    """a, b: links that join all components which pairs of the blocks ``one`` and ``two`` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (c[k].as_py() for c in batch.columns)
                sides = [one, one if two is None else two]
                sets = [[np.frombuffer(m["data"], np.int64) for m in side] for side in sides]
                both = overlaps(*sets)
                n = [np.array([len(x) for x in side], np.float64) for side in sets]
                good = both / (n[0][:, None] + n[1][None] - both) >= least
                comps = [np.array([m["comp"] for m in side]) for side in sides]
                good &= comps[0][:, None] != comps[1][None]
                root: dict[int, int] = {}

                def find(c: int) -> int:
                    while (up := root.get(c, c)) != c:
                        c = up
                    return c

                found = []
                for i, j in np.argwhere(good).tolist():
                    x, y = find(sides[0][i]["comp"]), find(sides[1][j]["comp"])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((sides[0][i]["node"], sides[1][j]["node"]))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("one", "two").mapInArrow(run, "a long, b long")


def blocks_of(entries: DataFrame) -> DataFrame:
    """node, block and what else is the same in all of a node's ``entries`` (n, members, key, ...).

    Documents that share their largest bucket share a block, or one of several if they are many.
    """
    others = [c for c in entries.columns if c not in ("node", "key", "members")]
    each = entries.groupBy("node").agg(*(F.max(c).alias(c) for c in others), F.sum("members").alias("rank"), F.max(F.struct("members", "key"))["key"].alias("home"))
    homes = each.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
    return each.join(homes, "home").select("node", "rank", *others, block.alias("block"))


def few(df: DataFrame) -> DataFrame:
    """``df``, a table of ids, to be broadcast if it is short enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` plus ``salt``, which deals the rows of a large bucket (members) over several keys."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.floor(F.col("members") / KEY_ROWS) + 1))


def copied(df: DataFrame) -> DataFrame:
    """``df`` once for each salt of its bucket."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("members") / KEY_ROWS)))).drop("members")


def still_open(entries: DataFrame) -> DataFrame:
    """Entries of buckets that hold several components."""
    open_ = entries.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return entries.join(open_, "key", "left_semi")


def linked(docs: DataFrame, sketched: DataFrame, scratch: Scratch, least: float) -> tuple[DataFrame, DataFrame]:
    """(text_hash, node, copies) of texts with words, and (node, comp) of those that have links."""
    nodes = sketched.where("doc_id is not null and size(bands) > 0").groupBy("text_hash").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n", "bands"), "doc_id").alias("s"), F.count("*").alias("copies"))
    each = nodes.select("node", "s.n", F.explode("s.bands").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    entries = scratch.write(each.join(shared, "key"))
    involved = scratch.write(blocks_of(entries))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), whole_text().alias("text"))
    packs = scratch.write(packed(texts.join(few(involved.select("node", "block")), "node").dropDuplicates(["node"])))
    # First the member of each bucket that shares most buckets, with all others.
    ranked = entries.join(involved.select("node", "rank", "block"), "node")
    first = F.max_by(F.struct("node", "n", "block", "members"), F.struct("rank", -F.col("node")))
    hubs = ranked.groupBy("key").agg(first.alias("h")).select("key", F.col("h.node").alias("node_b"), F.col("h.n").alias("n_b"), F.col("h.block").alias("block_b"), "h.members")
    near = F.least("n", "n_b") >= F.lit(least - 1e-9) * F.greatest("n", "n_b")
    met = dealt(ranked, "node").join(copied(hubs), ["key", "salt"]).where((F.col("node") != F.col("node_b")) & near)
    less = F.col("node") < F.col("node_b")
    side = lambda c: (F.when(less, F.col(c)).otherwise(F.col(f"{c}_b")), F.when(less, F.col(f"{c}_b")).otherwise(F.col(c)))
    (a, b), (block_a, block_b) = side("node"), side("block")
    pairs = scratch.write(met.select(a.alias("a"), b.alias("b"), block_a.alias("block_a"), block_b.alias("block_b")).distinct())
    links = scratch.write(verified(pairs, packs, least)).where("ok").select("a", "b")
    comps = components(links, scratch.write)
    # Then the pairs of a bucket that are in different components.
    give_back(docs.sparkSession)  # the plans so far were large ones
    left = scratch.write(still_open(entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))))
    old = involved.select("node", F.col("block").alias("old"))
    packs = packs.join(few(left.select("node").distinct().join(old, "node").select(F.col("old").alias("block")).distinct()), "block", "left_semi")
    alone = shared_shingles(packs, few(left.select("node").distinct()))
    left = left.join(alone, "node", "left").where(F.col("n") - F.coalesce("alone", F.lit(0)) >= F.lit(least - 1e-9) * F.col("n")).drop("alone")
    left = scratch.write(still_open(left))
    if not left.isEmpty():
        placed = scratch.write(blocks_of(left))
        keyed = left.select("node", "key", "members").join(placed.select("node", "block"), "node").select("key", "members", "block").distinct()
        other = copied(keyed.withColumnRenamed("block", "y"))
        met = scratch.write(dealt(keyed, "block").join(other, ["key", "salt"]).where("block <= y").select(F.col("block").alias("x"), "y").distinct())
        more = block_links(with_blocks(met, met, scratch.write(repacked(packs, placed))), least)
        comps = components(links.unionByName(scratch.write(more)), scratch.write)
    return nodes.select("text_hash", "node", "copies"), comps


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least id of the class) and class_size for every row of ``docs``.

    Documents are linked if their multisets of five-word shingles have a weighted Jaccard
    similarity of ``least`` or more; classes are the components. Equal word sequences are linked
    always; texts without words (null, empty) never are. Rows with one id count as one document.
    Rows with a null id take the class of their text's other rows, and have none without any.
    A pair of exactly 0.8 similarity shares a bucket with a probability of 0.999997.
    """
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.write(sketch(docs))
    of_text, comps = linked(docs, sketched, scratch, least)
    of_text = scratch.write(of_text.join(comps, "node", "left").select("text_hash", "copies", F.coalesce("comp", "node").alias("of_text")))
    # A text without words has no class but its own row's. A text or class may have most rows.
    named = spread_join(sketched.select("doc_id", "text_hash"), of_text, ["text_hash"], "copies", "left")
    named = scratch.write(named.select("doc_id", F.coalesce("of_text", "doc_id").alias("class_id")))
    sizes = scratch.write(named.groupBy("class_id").agg(F.count("*").alias("class_size"))).withColumn("weight", F.col("class_size"))
    out = stash(spread_join(named, sizes, ["class_id"], "weight", "left").select("doc_id", "class_id", "class_size"))
    scratch.delete()
    return out


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` but those whose class has a lesser id."""
    gone = classes(docs, least).where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
