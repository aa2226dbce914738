"""Exact top-k search by inner product over a pivot-distance index.

Vectors become whole numbers. Each is keyed by its nearest pivot and, among those of a pivot, by
its distance in one of some rings (annuli). Of a ring only its count, its least and greatest
distance and its longest vector are kept. For a query at distance d from the pivot, the triangle
inequality puts every vector of a ring at least max(0, d - outer, inner - d) away, and so bounds
the inner product by (|q|^2 + longest^2 - away^2) / 2. A query visits rings in order of that
bound: a few, then some more, then all whose bound is no less than its k-th best score so far.
Nothing that could be among the k best is left out, whatever the pivots are.

Queries meet vectors by ring: both are shuffled to the ring's parts of about ``PART_ROWS`` vectors,
sorted, and streamed, so a ring with most of the vectors is many parts, and a task holds one part.
Pivots are fitted on a bounded sample; the rings' summary has ``MAX_PIVOTS * MAX_RINGS`` rows at most.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part; vectors are
compared only with those of as many components; rows with one id are vectors of their own, each
a query if its id is; a null id is no query and comes last in ties; scores and components beyond
64 bits count as the ends of that range. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, stash

SCALE = 64
K = 20
#: The rows, about, that pivots and rings are fitted on, and the most components of them all.
SAMPLE_ROWS = 4096
SAMPLE_COMPONENTS = 4 << 20
MAX_PIVOTS = 256
MAX_RINGS = 256
#: Vectors to a ring, about, and to a part of a ring that has more.
RING_ROWS = 512
PART_ROWS = 4096
#: Rings that each round but the last adds to a query's.
EXPAND = (4, 32)
_LEAST = -(1 << 63)
_NO_ID = (1 << 63) - 1

BASE = "row long, vec_id long, query boolean, cell int, dist double, norm double, vec binary"
VISIT = "row long, vec_id long, vec binary, seen array<int>, cells array<int>"
FOUND = "row long, query_id long, vec_id long, c_row long, score long"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they fit in; the first byte says how many."""
    for kind in (np.int8, np.int16, np.int32):
        small = x.astype(kind)
        if (small == x).all():
            return bytes([small.itemsize]) + small.tobytes()
    return bytes([8]) + x.tobytes()


def unpack(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, f"<i{cell[0]}", offset=1).astype(np.int64)


def stacked(cells: list[bytes]) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    if len({(c[0], len(c)) for c in cells}) == 1:
        return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)[:, 1:].copy().view(f"<i{cells[0][0]}").astype(np.int64)
    return np.stack([unpack(c) for c in cells])


@dataclass
class Index:
    """Pivots by number of components, and ring borders by pivot."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int]  # the number of a dimension's first pivot
    borders: list[np.ndarray]
    rings: int

    def of_dimension(self, n: int) -> tuple[np.ndarray, int]:
        """Pivots; a dimension without any (it has no row in the sample) has the origin for one."""
        return (self.pivots[n], self.first[n]) if n in self.pivots else (np.zeros((1, n)), -1 - n)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell (pivot and ring) of each vector, and the distance to the pivot."""
        pivots, first = self.of_dimension(x.shape[1])
        gaps = distances(x.astype(np.float64), pivots)
        near = gaps.argmin(1)
        dist = gaps[np.arange(len(x)), near]
        if first < 0:
            return np.full(len(x), first, np.int64), dist
        ring = np.array([np.searchsorted(self.borders[first + p], d, "right") for p, d in zip(near.tolist(), dist.tolist(), strict=True)], np.int64)
        return (first + near) * self.rings + ring, dist


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def fit(sample: list[list[int]], n: int, seed: int = 0, rounds: int = 5) -> Index:
    """Pivots by a few rounds of k-means, and rings by quantiles of the distances to them.

    ``n`` is how many vectors there are. The numbers of pivots and rings follow it up to their bounds.
    """
    wanted = int(min(MAX_PIVOTS, max(1, round(n**0.5 / 4))))
    rings = int(min(MAX_RINGS, max(1, -(-n // (wanted * RING_ROWS)))))
    by: dict[int, list[list[int]]] = {}
    for x in sample:
        by.setdefault(len(x), []).append(x)
    rng = np.random.default_rng(seed)
    index = Index({}, {}, [], rings)
    for size, rows in sorted(by.items()):
        x = np.unique(np.array(rows, np.float64).reshape(len(rows), size), axis=0)
        take = max(1, min(len(x), round(wanted * len(rows) / len(sample))))
        pivots = x[np.sort(rng.choice(len(x), take, replace=False))]
        for _ in range(rounds):
            near = distances(x, pivots).argmin(1)
            pivots = np.stack([x[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(take)])
        gaps = distances(x, pivots)
        near = gaps.argmin(1)
        index.pivots[size], index.first[size] = pivots, len(index.borders)
        for k in range(take):
            own = np.sort(gaps[near == k, k])
            index.borders.append(np.unique(np.quantile(own, np.arange(1, rings) / rings)) if len(own) and rings > 1 else np.zeros(0))
    return index


def whole(vectors: DataFrame, query: Column, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """row, vec_id, query, x (whole numbers) of the vectors that take part."""
    c = F.col(embedding)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ends = lambda v: F.least(F.greatest(v, F.lit(float(_LEAST))), F.lit(float(1 << 62) * 2))
    x = F.transform(c, lambda v: F.floor(ends(F.lit(float(scale)) * v.cast("double"))))
    return vectors.where(c.isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("query"), x.cast("array<long>").alias("x"))


def indexed(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with cell, distance to the pivot, squared length and packed components."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, values = batch.column(3), batch.column(3).flatten().to_numpy()
            sizes = cells.value_lengths().to_numpy() if batch.num_rows else np.zeros(0, np.int64)
            ends = np.cumsum(sizes)
            cell, dist, norm = (np.zeros(batch.num_rows, t) for t in (np.int64, np.float64, np.float64))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for k in range(0, len(at), max(1, (1 << 21) // max(1, int(size)))):
                    part = at[k : k + max(1, (1 << 21) // max(1, int(size)))]
                    x = values[(ends[part] - size)[:, None] + np.arange(size)]
                    cell[part], dist[part] = shared.value.place(x)
                    norm[part] = (x.astype(np.float64) ** 2).sum(1)
            vec = [pack(values[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(norm), pa.array(vec, pa.binary())], names=["row", "vec_id", "query", "cell", "dist", "norm", "vec"])

    return rows.select("row", "vec_id", "query", "x").mapInArrow(run, BASE)


@dataclass
class Rings:
    """What is known of every ring, by number of components: pivot, extent, longest vector."""

    cell: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    longest: np.ndarray

    def bounds(self, x: np.ndarray, index: Index) -> np.ndarray:
        """For each query and ring, a number that no inner product exceeds."""
        x = x.astype(np.float64)
        pivots, first = index.of_dimension(x.shape[1])
        d = distances(x, pivots)[:, self.cell // index.rings - first if first >= 0 else np.zeros(len(self.cell), int)]
        square = (x**2).sum(1)[:, None]
        away = np.maximum(0, np.maximum(d - self.outer, self.inner - d))
        # Rounding is far below this allowance.
        return np.minimum((square + self.longest - away**2) / 2, np.sqrt(square * self.longest)) + 1e-6 + 1e-9 * (square + self.longest)


def visits(queries: DataFrame, index: Index, rings: dict[int, Rings], most: int | None) -> DataFrame:
    """``queries`` (row, vec_id, vec, seen, floor) with the rings to visit next: ``most`` of highest bound, or all."""
    shared = queries.sparkSession.sparkContext.broadcast((index, rings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rings = shared.value
        for batch in batches:
            vec, seen = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            floor = batch.column(4).to_pylist()
            cells: list[list[int]] = [[]] * len(vec)
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(vec):
                groups.setdefault((len(v) - 1) // v[0], []).append(i)
            for size, members in groups.items():
                own = rings[size]
                step = max(1, (1 << 20) // len(own.cell))
                for k in range(0, len(members), step):
                    part = members[k : k + step]
                    bound = own.bounds(stacked([vec[i] for i in part]), index)
                    for i, b in zip(part, bound, strict=True):
                        b[np.isin(own.cell, seen[i])] = -np.inf
                        good = np.flatnonzero(b >= (-np.inf if floor[i] is None else floor[i]))
                        good = good[b[good] > -np.inf]
                        if most is not None and len(good) > most:
                            good = good[np.argsort(-b[good], kind="stable")[:most]]
                        cells[i] = own.cell[good].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s + c for s, c in zip(seen, cells, strict=True)], pa.list_(pa.int32())), pa.array(cells, pa.list_(pa.int32()))], names=["row", "vec_id", "vec", "seen", "cells"])

    return queries.select("row", "vec_id", "vec", "seen", "floor").mapInArrow(run, VISIT)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where those are exact, else in whole numbers of any size."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    for kind, limit in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if most < limit:
            return q.astype(kind) @ c.astype(kind).T
    return np.clip(q.astype(object) @ c.astype(object).T, _LEAST + 1, _NO_ID).astype(np.int64).reshape(len(q), len(c))


def best_of(q: tuple, c: tuple, k: int) -> list[np.ndarray]:
    """row, query_id, vec_id (as a key), c_row, score of the ``k`` best of one part for each query.

    ``q`` has row, vec_id, vectors and the score that must be reached; ``c`` row, vec_id key, vectors.
    """
    s = scores(q[2], c[2])
    lowest = s.dtype.type(_LEAST) if s.dtype == np.int64 else -np.inf
    order = np.argsort(c[0])
    at = np.minimum(np.searchsorted(c[0][order], q[0]), len(order) - 1)
    own = np.flatnonzero(c[0][order[at]] == q[0])
    s[own, order[at[own]]] = lowest
    least = q[3].astype(s.dtype)
    if s.shape[1] > k:
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
    i, j = np.nonzero((s >= least[:, None]) & (s > lowest))
    value = s[i, j].astype(np.int64)
    order = np.lexsort((c[0][j], c[1][j], -value, i))
    i, j, value = i[order], j[order], value[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    i, j = i[keep], j[keep]
    return [q[0][i], q[1][i], c[1][j], c[0][j], value[keep]]


def met(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best of each part for each query that visits it.

    Both have cell and part; rows of a part come together, its vectors first.
    """
    names = ["cell", "part", "kind", "row", "vec_id", "vec", "floor"]
    one = candidates.select("cell", "part", F.lit(0).alias("kind"), "row", "vec_id", "vec", F.lit(None).cast("long").alias("floor"))
    two = asked.select("cell", "part", F.lit(1).alias("kind"), "row", "vec_id", "vec", "floor")
    rows = one.unionByName(two).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, kind, row = (batch.column(i).to_numpy() for i in range(4))
            ids = batch.column(4).fill_null(_NO_ID).to_numpy()
            floor = batch.column(6).fill_null(_LEAST).to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
                if (cell[a], part[a]) != now:
                    now, held, ready = (cell[a], part[a]), [], None
                if kind[a] == 0:
                    held.append((row[a:b], ids[a:b], stacked(batch.column(5).slice(a, b - a).to_pylist())))
                    continue
                if ready is None and held:
                    ready, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
                if ready is not None:
                    for lo in range(a, b, 512):
                        hi = min(b, lo + 512)
                        q = row[lo:hi], ids[lo:hi], stacked(batch.column(5).slice(lo, hi - lo).to_pylist()), floor[lo:hi]
                        out.append(best_of(q, ready, k))
            if out:
                r, q, v, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(q), pa.array(v, mask=v == _NO_ID), pa.array(c), pa.array(s)], names=["row", "query_id", "vec_id", "c_row", "score"])

    return rows.mapInArrow(run, FOUND)


def ring_summary(base: DataFrame, index: Index) -> tuple[dict[int, Rings], dict[int, int]]:
    """The rings by number of components, and how many parts each cell has."""
    size = F.expr("cast((octet_length(vec) - 1) div conv(hex(substring(vec, 1, 1)), 16, 10) as int)").alias("size")
    rows = base.groupBy("cell", size).agg(F.count("*").alias("n"), F.min("dist").alias("inner"), F.max("dist").alias("outer"), F.max("norm").alias("longest")).collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["cell"]):
        by.setdefault(r["size"], []).append(r)
    rings = {s: Rings(np.array([r["cell"] for r in found], np.int64), *(np.array([r[c] for r in found]) for c in ("inner", "outer", "longest"))) for s, found in by.items()}
    return rings, {r["cell"]: -(-r["n"] // PART_ROWS) for r in rows}


def search(vectors: DataFrame, query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, expand: tuple[int, ...] = EXPAND) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each row that ``query`` marks.

    All other rows are candidates. Ties go to the smaller id. The result is a written table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = whole(vectors, query, vec_id, embedding, scale)
    n, size = rows.agg(F.count("*"), F.avg(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = max(1, min(SAMPLE_ROWS, int(SAMPLE_COMPONENTS / max(1.0, size))))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(-(-n // most))) == 0).select("x").limit(2 * most)
    index = fit([x["x"] for x in picked.collect()], n)
    base = scratch.write(indexed(rows, index))
    rings, parts = ring_summary(base, index)
    split = spark.createDataFrame(sorted(parts.items()), "cell int, parts int")  # bounded by the rings
    candidates = base.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    asked = base.where("query").select("row", "vec_id", "vec", F.array().cast("array<int>").alias("seen"), F.lit(None).cast("long").alias("floor"))
    best = None
    for step in (*expand, None):
        next_ = scratch.write(visits(asked, index, rings, step))
        if next_.where(F.size("cells") > 0).isEmpty():
            break
        floors = asked.select("row", "floor")
        each = next_.join(floors, "row").select("row", "vec_id", "vec", "floor", F.explode("cells").alias("cell")).join(F.broadcast(split), "cell")
        each = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))))
        found = met(candidates, each, k)
        found = found if best is None else found.unionByName(best)
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_row")
        best = scratch.write(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        reached = best.groupBy("row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
        asked = scratch.write(next_.drop("cells").join(reached, "row", "left").select("row", "vec_id", "vec", "seen", "floor"))
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_row")
    out = stash(best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score"))
    scratch.delete()
    return out


#: The rows of the registered search in DuckDB's SQL; doubles are exact for numbers this small.
ORACLE = f"""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as x
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select q.row, q.vec_id as query_id, c.vec_id, c.row as c_row, list_inner_product(q.x, c.x)::bigint as score
  from v as q join v as c on len(q.x) = len(c.x) and q.row <> c.row where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by row order by score desc, vec_id nulls last, c_row)::int as rank, vec_id, score
from pairs qualify rank <= {K}
"""
