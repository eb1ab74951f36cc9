"""Nearest neighbours by inner product: stable projections in kd-trees, searched until a chi-square test holds.

Vectors are lifted by one coordinate so that all have the length of the longest, and a query is scaled to that length
(which changes no order): the largest inner product is then the least distance. All are projected on DIMENSIONS Gaussian
directions. The upper levels of one kd-tree over the projections, with splits from a sample of SAMPLE rows at most, deal
the rows to cells; a cell over the size of a block is dealt on by hash, so that no task holds more than a block, even of
equal vectors. Each block holds the lower levels.

A query first visits the NEAR cells that are nearest in projection, which gives it a k-th best distance. The squared ratio
of projected to true distance follows a chi-square distribution, so a vector as near as the present k-th is projected
beyond `reach` times its distance with probability 1 - PROBABILITY only. In a second round the query visits just the cells
whose boxes begin within its reach, and in a block the leaves, nearest first, until the next one is beyond it; of a leaf's
vectors those projected within reach are scored, exactly, and the best of them shorten the reach. So no list of all
queries by all blocks is made, unless all blocks are within reach. Every row is indexed; expected recall is PROBABILITY at
least.

Defined results: rows whose vec_id or vector is null, or whose vector is empty, zero or holds null or non-finite
components, take no part; rows that repeat a vec_id count once, with the least vector; vectors of another length than
the query's are no candidates; ties among the vectors found go to the smaller vec_id; an empty table gives an empty result;
further columns are not passed on. A very long vector makes a block by itself.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import intermediates, materialize

DIMENSIONS = 24
PROBABILITY = 0.88
LEAF = 64
#: Numbers in a block of vectors and in a block of queries, about.
BLOCK, QUERY_BLOCK = 1 << 19, 1 << 17
#: Rows that the splits are taken from, and cells, at most; cells that a query visits first.
SAMPLE, CELLS, NEAR = 65_536, 16_384, 3
SEED = 3


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def chi_square(x: np.ndarray, dimensions: int = 8) -> np.ndarray:
    """Distribution function for an even number of dimensions."""
    half = x / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dimensions // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


@cache
def quantile(probability: float, dimensions: int = DIMENSIONS) -> float:
    """Where the distribution function is `probability`."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), dimensions) < probability else (low, mid)
    return high


@cache
def directions(length: int) -> np.ndarray:
    """Gaussian directions for lifted vectors of `length` components; the last row is that of the coordinate lifted by."""
    return np.random.default_rng([SEED, length]).standard_normal((length + 1, DIMENSIONS))


class Tree(NamedTuple):
    """Splits of the upper levels: rows with projection[axis] <= at go left; a child below 0 is the cell ~child."""

    axis: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64) if len(self.axis) else np.full(len(points), -1)
        while (on := np.flatnonzero(node >= 0)).size:
            n = node[on]
            node[on] = np.where(points[on, self.axis[n]] <= self.at[n], self.left[n], self.right[n])
        return ~node


def upper_tree(points: np.ndarray, cells: int) -> Tree:
    """At most `cells` cells with about as many of the points each, equal points counted once, as they cannot be parted."""
    points = np.unique(points, axis=0)
    splits: list[list] = []
    done: list[tuple[int, int]] = []
    todo = [(-len(points), 0, np.arange(len(points)), -1, 0)]  # the largest first: rows, parent, side
    while todo and len(splits) + 1 < cells:
        size, _, rows, parent, side = heapq.heappop(todo)
        if size >= -1:
            done.append((parent, side))
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        values = points[rows, axis]
        at = float(np.median(values))
        if not (values > at).any():  # the median is the largest value
            at = float(values[values < at].max())
        low = values <= at
        if parent >= 0:
            splits[parent][2 + side] = len(splits)
        splits.append([axis, at, 0, 0])
        for half, which in ((rows[low], 0), (rows[~low], 1)):
            heapq.heappush(todo, (-len(half), 2 * len(splits) + which, half, len(splits) - 1, which))
    for i, (parent, side) in enumerate([*done, *((p, s) for *_, p, s in todo)]):
        if parent >= 0:
            splits[parent][2 + side] = ~i
    columns = list(zip(*splits, strict=True)) or [[], [], [], []]
    return Tree(np.array(columns[0], np.int64), np.array(columns[1], float), np.array(columns[2], np.int64), np.array(columns[3], np.int64))


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """points x boxes: squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        p = points[:, j, None]
        out += np.maximum(np.maximum(low[None, :, j] - p, p - high[None, :, j]), 0) ** 2
    return out


def leaves(points: np.ndarray, most: int = LEAF) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A kd-tree's leaves (row numbers) with the corners of their boxes; halves are of equal size even among ties."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = np.argpartition(points[rows, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done, np.array([points[r].min(axis=0) for r in done]), np.array([points[r].max(axis=0) for r in done])


class Rows(NamedTuple):
    """Vectors with their projections: those of candidates are lifted, those of queries scaled."""

    ids: np.ndarray
    x: np.ndarray
    projected: np.ndarray


def search(rows: Rows, queries: Rows, k: int, longest: float, kth: np.ndarray | None = None, probability: float = PROBABILITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scores, how many were scored) of each query's k nearest rows, nearest first; scores are -inf where fewer.

    longest: the squared length that all are lifted or scaled to. kth: scores that the k-th best of each query has elsewhere.
    """
    n = len(queries.ids)
    best_ids, best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
    kth = np.full(n, -np.inf) if kth is None else kth
    scale = math.sqrt(longest) / np.sqrt(np.einsum("qd,qd->q", queries.x, queries.x))
    times, scored = quantile(probability), np.zeros(n, np.int64)
    tree, low, high = leaves(rows.projected)
    gap = gaps(queries.projected, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(tree)), order.shape), 1)

    def reach(who: np.ndarray) -> np.ndarray:
        known = np.maximum(best[who, k - 1], kth[who])
        return np.where(np.isneginf(known), np.inf, times * np.maximum(2 * longest - 2 * known * scale[who], 1e-9 * longest))

    start, width = 0, 1
    while start < len(tree):  # the next leaves of every query at once, more and more of them
        for j in range(len(tree)):
            who = np.flatnonzero((place[:, j] >= start) & (place[:, j] < start + width))
            who = who[gap[who, j] < reach(who)]
            if not len(who):
                continue
            at = tree[j]
            p, q = rows.projected[at], queries.projected[who]
            away = (q**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * (q @ p.T)
            near = (away < reach(who)[:, None]) & (queries.ids[who][:, None] != rows.ids[at][None, :])
            a, b = np.nonzero(near)
            if not len(a):
                continue
            scores = np.full(near.shape, -np.inf)
            for s in range(0, len(a), 1 << 16):
                i, r = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                scores[i, r] = np.einsum("id,id->i", queries.x[who[i]], rows.x[at[r]])
            scored[who] += near.sum(axis=1)
            every = np.concatenate([best[who], scores], axis=1)
            named = np.concatenate([best_ids[who], np.broadcast_to(rows.ids[at], scores.shape)], axis=1)
            named[np.isneginf(every)] = np.iinfo(np.int64).max
            top = np.lexsort((named, -every), axis=-1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(every, top, 1), np.take_along_axis(named, top, 1)
        start, width = start + width, 2 * width
    return best_ids, best, scored


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows, vectors of one length at a time."""
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        yield batch.filter(pa.array(dim == d))


def projected(used: DataFrame) -> DataFrame:
    """(vec_id, dim, v, raw, squared) of (vec_id, v): raw projections, without the lift, and squared lengths."""
    kind = dict(used.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch):
                x = matrix(part.column("v"), part.num_rows)
                made = [lists(x @ directions(x.shape[1])[:-1]), pa.array(np.einsum("nd,nd->n", x, x))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], ["vec_id", "dim", "v", "raw", "squared"])

    return used.select("vec_id", F.size("v").alias("dim"), "v").mapInArrow(run, f"vec_id long, dim int, v {kind}, raw array<double>, squared double")


class Index:
    """The upper tree, the boxes of its cells, and how vectors are lifted and scaled."""

    def __init__(self, vectors: DataFrame, cells: int, longest: float):
        self.longest = longest
        some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "raw", "squared").limit(SAMPLE).toArrow() if cells > 1 else None
        points = np.concatenate([self.lifted(part) for batch in some.to_batches() for part in by_length(batch)]) if some is not None else np.zeros((0, DIMENSIONS))
        self.tree = upper_tree(points, cells)
        self.low = self.high = np.zeros((0, DIMENSIONS))
        self.cells = np.zeros(0, np.int64)

    def lifted(self, part: pa.RecordBatch) -> np.ndarray:
        """Projections of candidates of one length."""
        up = np.sqrt(np.maximum(self.longest - part.column("squared").to_numpy(), 0))
        return matrix(part.column("raw"), part.num_rows) + up[:, None] * directions(part.column("dim")[0].as_py())[-1]

    def scaled(self, part: pa.RecordBatch) -> np.ndarray:
        """Projections of queries of one length."""
        return matrix(part.column("raw"), part.num_rows) * np.sqrt(self.longest / part.column("squared").to_numpy())[:, None]

    def placed(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, dim, v, p, cell) of candidates."""
        index, kind = self.copy(), dict(vectors.dtypes)["v"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_length(batch):
                    points = index.lifted(part)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "dim", "v")), lists(points), pa.array(index.tree.cell(points))], ["vec_id", "dim", "v", "p", "cell"])

        return vectors.mapInArrow(run, f"vec_id long, dim int, v {kind}, p array<double>, cell long")

    def copy(self) -> Index:
        """What workers need of the index: a few megabytes at most, as CELLS bounds it."""
        made = object.__new__(Index)
        made.__dict__.update(self.__dict__)
        return made

    def bounded(self, boxes: list) -> None:
        """Take the cells' boxes: (cell, low and high by dimension)."""
        self.cells = np.array([r["cell"] for r in boxes], np.int64)
        self.low = np.array([[r[f"low{i}"] for i in range(DIMENSIONS)] for r in boxes]).reshape(-1, DIMENSIONS)
        self.high = np.array([[r[f"high{i}"] for i in range(DIMENSIONS)] for r in boxes]).reshape(-1, DIMENSIONS)

    def routed(self, queries: DataFrame, near: int, probability: float, first: bool) -> DataFrame:
        """(vec_id, dim, v, p, kth, cell): the cells that each query visits in the first round, or those left in the second."""
        index, kind, times = self.copy(), dict(queries.dtypes)["v"], quantile(probability)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_length(batch):
                    for a in range(0, part.num_rows, 512):
                        some = part.slice(a, 512)
                        points, kth = index.scaled(some), some.column("kth").to_numpy(zero_copy_only=False)
                        gap = gaps(points, index.low, index.high)
                        rank = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1)
                        goes = rank < near
                        if not first:
                            known = 2 * index.longest - 2 * kth * np.sqrt(index.longest / some.column("squared").to_numpy())
                            reach = np.where(np.isneginf(kth), np.inf, times * np.maximum(known, 1e-9 * index.longest))
                            goes = ~goes & (gap < reach[:, None])
                        q, c = np.nonzero(goes)
                        rows = some.take(pa.array(q))
                        yield pa.RecordBatch.from_arrays(
                            [*(rows.column(x) for x in ("vec_id", "dim", "v")), lists(points[q]), rows.column("kth"), pa.array(index.cells[c])],
                            ["vec_id", "dim", "v", "p", "kth", "cell"],
                        )

        return queries.mapInArrow(run, f"vec_id long, dim int, v {kind}, p array<double>, kth double, cell long")


FOUND = "query_id long, vec_id long, score double, scored long"


def visits(index: Index, vectors: DataFrame, sizes: DataFrame, asked: DataFrame, k: int, block: int, query_block: int, probability: float) -> DataFrame:
    """FOUND of the queries in the blocks of the cells that they are sent to."""
    asked = materialize(asked, "visits")
    crowd = asked.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") / query_block).cast("int").alias("chunks"))
    dealt = materialize(sizes.join(crowd, ["dim", "cell"]).select("dim", "cell", F.ceil(F.col("n") * F.col("dim") / block).cast("int").alias("blocks"), "chunks"), "dealt")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    left = index.placed(vectors).join(dealt, ["dim", "cell"]).withColumn("b", part("blocks", 1)).withColumn("q", every("chunks")).select("dim", "cell", "b", "q", "vec_id", "v", "p")
    right = asked.join(dealt, ["dim", "cell"]).withColumn("q", part("chunks", 2)).withColumn("b", every("blocks")).select("dim", "cell", "b", "q", "vec_id", "v", "p", "kth")
    longest = index.longest

    def local(some: pa.Table, queries: pa.Table) -> pa.Table:
        if not some.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "scored": pa.array([], pa.int64())})
        rows, asks = (Rows(t.column("vec_id").to_numpy(), matrix(t.column("v"), t.num_rows), matrix(t.column("p"), t.num_rows)) for t in (some, queries))
        ids, scores, scored = search(rows, asks, k, longest, queries.column("kth").to_numpy(), probability)
        good = ~np.isneginf(scores)
        good[:, 0] = True  # a query's first row tells how many were scored, even if none was
        told = np.zeros(scores.shape, np.int64)
        told[:, 0] = scored
        none = pa.array(np.isneginf(scores[good]))
        return pa.table({"query_id": np.repeat(asks.ids, k)[good.ravel()], "vec_id": pa.array(ids[good], mask=none.to_numpy(zero_copy_only=False)), "score": scores[good], "scored": told[good]})

    key = ["dim", "cell", "b", "q"]
    return materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(local, FOUND), "found")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def found_by(rows: DataFrame, is_query: Column, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK, probability: float = PROBABILITY) -> DataFrame:
    """FOUND: all vectors that were near enough to be kept by some block, with how many were scored."""
    used = rows.where(usable(F.col("embedding"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("v"))
    vectors = materialize(projected(used), "vectors")
    numbers, longest = vectors.agg(F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0)), F.coalesce(F.max("squared"), F.lit(0.0))).first()
    index = Index(vectors, max(1, min(CELLS, math.ceil(numbers / block))), longest)
    corner = [f(F.get("p", i)).alias(f"{name}{i}") for i in range(DIMENSIONS) for f, name in ((F.min, "low"), (F.max, "high"))]
    sizes = materialize(index.placed(vectors).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), *corner), "sizes")
    index.bounded(sizes.groupBy("cell").agg(*[f(f"{name}{i}").alias(f"{name}{i}") for i in range(DIMENSIONS) for f, name in ((F.min, "low"), (F.max, "high"))]).collect())  # CELLS rows at most
    sizes = sizes.select("dim", "cell", "n")
    queries = vectors.where(is_query)
    one = visits(index, vectors, sizes, index.routed(queries.withColumn("kth", F.lit(-math.inf)), NEAR, probability, True), k, block, query_block, probability)
    have = best_of(one, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    again = queries.join(have, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-math.inf)))
    return one.unionByName(visits(index, vectors, sizes, index.routed(again, NEAR, probability, False), k, block, query_block, probability))


def nearest(rows: DataFrame, is_query: Column, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `rows` (vec_id, embedding) where is_query, its k nearest others."""
    with intermediates(rows.sparkSession) as keep:
        found = found_by(rows, is_query, k, block, query_block)
        keep.append(found)
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)
