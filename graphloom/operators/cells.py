"""An inverted file over vectors: rows stored by the cell of their nearest centroid, searched exactly.

Centroids come from a bounded sample (SAMPLE rows, the first by a hash of the key); every
row is stored under its nearest one, and of each cell the number of rows and the least and
greatest distance from the centroid are known. Vectors are compared at unit length, where
cosine and distance say the same. A vector of a cell lies at least |query - centroid| -
greatest, and at least least - |query - centroid|, from the query. A search reads the nearest cells
first and then just those whose bound doesn't put them behind the k-th row found, so it
equals a scan of everything. What it skips depends on the data: vectors in groups leave
most cells closed, vectors spread evenly over many dimensions leave none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.vectors import cosine, top_k
from graphloom.sources.files import shared_path

#: Rows that centroids are fitted on; cells at most; passes over the sample; rows per result that the first cells hold.
SAMPLE, MOST_CELLS, PASSES, FIRST_ROWS = 20_000, 1024, 8, 4
#: Room for rounding in distances, far above that of single precision's products.
ROOM = 1e-6
#: Bytes of a stripe, rows that one has at least if there are several, rows of a tile and queries that are compared with it at once.
STRIPE_BYTES, LEAST_ROWS, TILE, QUERIES = 1 << 26, 1024, 2048, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, distance from it) of unit vectors."""
    square = 1 + (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    cell = square.argmin(1)
    return cell, np.sqrt(((x - centroids[cell]) ** 2).sum(1))


def centroids_of(x: np.ndarray, n: int) -> np.ndarray:
    """n centroids of unit vectors: rows that lie far from each other, then means of the rows nearest to each."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    far = np.full(len(x), np.inf)
    chosen = [0]
    for _ in range(min(n, len(x)) - 1):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    c = x[chosen]
    for _ in range(PASSES):
        cell, _ = _nearest(x, c)
        size = np.bincount(cell, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


@dataclass(frozen=True)
class Cells:
    """A stored index: its folder, and of each cell the number of rows, distances from the centroid, and the centroid."""

    spark: SparkSession
    path: str
    key: str
    vector: str
    schema: T.StructType
    cells: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    centroids: np.ndarray

    def read(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The rows with their `cell`; of some cells only their folders are read."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return rows if cells is None else rows.filter(F.col("cell").isin([int(c) for c in cells]))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances from the centroids, least distances from any row of the cells) of unit vectors."""
        away = np.sqrt(np.maximum(0, 1 + (self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T))
        return away, np.maximum(0, np.maximum(away - self.greatest, self.least - away)) - ROOM

    def first(self, away: np.ndarray, rows: int) -> np.ndarray:
        """Places of the nearest cells that hold so many rows together."""
        order = np.argsort(away, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.rows[order]), rows)) + 1]


def write_index(items: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ()) -> Cells:
    """Store the rows with a vector that isn't zero, by cells; null, zero and non-finite vectors are like nothing and left out."""
    spark, path = items.sparkSession, shared_path(items.sparkSession, "cells")
    known = items.select(key, vector, *keep).filter(F.expr(f"exists({vector}, x -> x <> 0) and forall({vector}, x -> x is not null and not isnan(x) and abs(x) <> double('inf'))"))
    sample = [r[0] for r in known.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).collect()]  # a bounded sample
    n = known.count()
    x = _unit(np.array(sample, float)) if sample else np.zeros((0, 1))
    centroids = centroids_of(x, min(MOST_CELLS, max(1, int(np.sqrt(n)))))

    @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    def place(v: pa.Array) -> pa.Array:
        cell, away = _nearest(_unit(_floats(v, centroids.shape[1])), centroids)
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(away, pa.float64())], names=["cell", "away"])

    placed = known.withColumn("p", place(vector)).select(key, vector, *keep, F.col("p.away").alias("away"), F.col("p.cell").alias("cell"))
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("cell", key).write.partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    facts = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).orderBy("cell").collect()  # one row per cell
    column = lambda c: np.array([r[c] for r in facts])
    cells = column("cell").astype(int)
    return Cells(spark, path, key, vector, placed.schema, cells, column("n"), column("low"), column("high"), centroids[cells] if len(cells) else centroids[:0])


def _scan(index: Cells, cells, where: Column | None, within: DataFrame | None) -> DataFrame:
    rows = index.read(cells)
    rows = rows if where is None else rows.filter(where)
    return rows if within is None else rows.join(within.select(index.key).distinct(), index.key, "left_semi")


def cells_for(index: Cells, query: Sequence[float], k: int, where: Column | None = None, within: DataFrame | None = None) -> list[int]:
    """The cells that hold the k rows most like the query: the nearest, and all that could have a better row than their k-th."""
    x = np.array([query], float)
    if not len(index.cells) or not np.isfinite(x).all() or not x.any():
        return []
    away, bound = (b[0] for b in index.bounds(_unit(x)))
    opened, size, best = np.zeros(len(index.cells), bool), FIRST_ROWS * k, []
    while len(best) < k and not opened.all():  # filters may leave few rows of the nearest cells
        near = index.first(away, size)
        new = near[~opened[near]]
        found = top_k(_scan(index, index.cells[new], where, within), query, k, key=index.key, vector=index.vector).collect()  # k rows
        best = sorted([*best, *(r["similarity"] for r in found)], reverse=True)[:k]
        opened[new] = True
        size *= 4
    limit = np.sqrt(max(0.0, 2 - 2 * best[-1])) if len(best) == k else np.inf
    return [int(c) for c in index.cells[opened | (bound <= limit + ROOM)]]


def nearest(index: Cells, query: Sequence[float], k: int, where: Column | None = None, within: DataFrame | None = None) -> DataFrame:
    """top_k() over the rows of the index (those of the keys in `within`, if given), from the cells that can hold them."""
    cells = cells_for(index, query, k, where, within)
    return top_k(_scan(index, cells, where, within), query, k, key=index.key, vector=index.vector)


def _floats(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors without nulls as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from left to right like those of vectors.dot()."""
    return np.cumsum(x * y, axis=1)[:, -1]


@dataclass
class _Stripe:
    """Rows of one stripe in the order of their cells; of equal vectors the k with the smallest keys."""

    ids: np.ndarray
    cells: np.ndarray
    x: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.x * self.x).sum(1))

    @classmethod
    def of(cls, ids: np.ndarray, cells: np.ndarray, x: np.ndarray, k: int) -> _Stripe:
        _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
        order = np.lexsort((ids, same))
        kept = np.zeros(len(ids), bool)
        kept[order] = np.arange(len(ids)) - np.searchsorted(same[order], same[order]) < k
        return cls(ids[kept], cells[kept], x[kept])

    def best(self, q: np.ndarray, opened: np.ndarray, cells: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, similarity) of the k best rows of each query in the cells that are opened for it.

        Tiles of products find what may be among them, which is computed again pair by pair;
        floor: a similarity that k rows are known to have.
        """
        unit, least = _unit(q), floor - ROOM
        hits, held = [], 0

        def shrink():
            query, row, near = (np.concatenate(h) for h in zip(*hits))
            order = np.lexsort((-near, query))
            query, row, near = query[order], row[order], near[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            last = rank == k - 1
            least[query[last]] = np.maximum(least[query[last]], near[last] - ROOM)
            ok = near >= least[query]
            return [(query[ok], row[ok], near[ok])]

        for start in range(0, len(self.ids), TILE):
            own = slice(start, start + TILE)
            places = np.searchsorted(cells, np.unique(self.cells[own]))
            asking = np.flatnonzero(opened[:, places].any(1))
            if not len(asking):
                continue
            near = unit[asking] @ self.x[own].T / self.norms[own]
            i, j = np.nonzero(near >= least[asking][:, None])
            hits.append((asking[i], j + start, near[i, j]))
            held += len(i)
            if held > 4 * k * len(q) + TILE:
                hits = shrink()
                held = len(hits[0][0]) // 2  # what couldn't shrink doesn't count again and again
        if not hits:
            return np.empty(0, np.int64), np.empty(0, self.ids.dtype), np.empty(0)
        query, row, _ = shrink()[0]
        size, own = np.sqrt(_sums(q, q)), np.sqrt(_sums(self.x, self.x))
        exact = [_sums(q[query[a : a + TILE]], self.x[row[a : a + TILE]]) for a in range(0, len(query), TILE)]
        similarity = np.concatenate([*exact, np.empty(0)]) / (own[row] * size[query])
        order = np.lexsort((self.ids[row], -similarity, query))
        query, row, similarity = query[order], row[order], similarity[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[first], self.ids[row[first]], similarity[first]


def nearest_batch(index: Cells, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """query_id, key, similarity, rank: the k nearest rows of each query (query_id, query) with a similarity of `least` or more.

    Rows are dealt to stripes of bounded size in the order of their cells. A task holds one
    and reads the queries that ask for it, which are compared with tiles of its rows; no
    pair of a query and a row is a row of Spark's. In two passes: the cells nearest to a
    query give a similarity that its k-th row has, and then only cells that can have such
    rows are opened. Zero, null and non-finite queries have no rows.
    """
    facts, total, dim = replace(index, spark=None), int(index.rows.sum()), index.centroids.shape[1]  # what the tasks get
    if not total:
        return index.spark.createDataFrame([], f"query_id long, {index.key} long, similarity double, rank long")
    n = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, min(n, -(-total // LEAST_ROWS)), -(-total * dim * 8 // STRIPE_BYTES))
    per = max(1, -(-total // stripes))
    ends = np.concatenate([[0], np.cumsum(index.rows)]).astype(np.int64)
    low, high = ends[:-1] // per, np.maximum(ends[1:] - 1, 0) // per  # the stripes that a cell is in
    numbers = np.zeros(1 + max(index.cells), np.int64)
    numbers[index.cells] = np.arange(len(index.cells))

    def opened(x: np.ndarray, floor: np.ndarray, near: bool) -> np.ndarray:
        """Which cells each query asks for: the nearest, or those that can have a row as similar as `floor`."""
        away, bound = facts.bounds(_unit(x))
        if not near:
            return bound <= (np.sqrt(np.maximum(0, 2 - 2 * floor)) + ROOM)[:, None]
        out = np.zeros(bound.shape, bool)
        for i, a in enumerate(away):
            out[i, facts.first(a, FIRST_ROWS * k)] = True
        return out

    def stripes_of(near: bool):
        @F.arrow_udf("array<int>")
        def places(q: pa.Array, floor: pa.Array) -> pa.Array:
            out, x, floors = [], _floats(q, dim), floor.to_numpy(zero_copy_only=False)
            for a in range(0, len(x), QUERIES):
                for row in opened(x[a : a + QUERIES], floors[a : a + QUERIES], near):
                    out.append(sorted({s for c in np.flatnonzero(row) for s in range(low[c], high[c] + 1)}))
            return pa.array(out, pa.list_(pa.int32()))

        return places

    def run(near: bool):
        def task(batches):
            at, parts, stripe = None, [], None
            for batch in batches:
                stripe_no, sides = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                cuts = np.flatnonzero((np.diff(stripe_no) != 0) | (np.diff(sides) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    part = batch.slice(a, b - a)
                    ids, cells, floor = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                    if stripe_no[a] != at:
                        at, parts, stripe = stripe_no[a], [], None
                    if sides[a] == 0:
                        parts.append((ids, cells, _floats(part.column(5), dim)))
                        continue
                    if parts:
                        stripe, parts = _Stripe.of(*(np.concatenate(c) for c in zip(*parts)), k), []
                    if stripe is None:
                        continue
                    x = _floats(part.column(5), dim)
                    for c in range(0, len(x), QUERIES):
                        own = slice(c, c + QUERIES)
                        query, key, similarity = stripe.best(x[own], opened(x[own], floor[own], near), facts.cells, floor[own], k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own][query]), pa.array(key), pa.array(similarity)], names=["query_id", facts.key, "similarity"])

        return task

    finite = "exists(query, x -> x <> 0) and forall(query, x -> x is not null and not isnan(x) and abs(x) <> double('inf'))"
    asked = queries.filter(finite).select(F.col("query_id").cast("long").alias("query_id"), "query").withColumn("floor", F.lit(float(least)))
    place = F.element_at(F.lit(ends[:-1][numbers].tolist()), F.col("cell") + 1)
    size = F.element_at(F.lit(index.rows[numbers].tolist()), F.col("cell") + 1)
    stripe = F.floor((place + F.pmod(F.xxhash64(index.key), size)) / F.lit(per)).cast("int").alias("stripe")
    rows = index.read().select(stripe, F.lit(0).alias("side"), F.col(index.key).cast("long").alias("id"), "cell", F.lit(0.0).alias("floor"), F.col(index.vector).cast("array<double>").alias("v"))

    def found(asked: DataFrame, near: bool) -> DataFrame:
        sent = asked.withColumn("q", F.col("query").cast("array<double>")).withColumn("stripe", F.explode(stripes_of(near)("q", "floor")))
        sent = sent.select("stripe", F.lit(1).alias("side"), F.col("query_id").alias("id"), F.lit(-1).alias("cell"), "floor", F.col("q").alias("v"))
        laid = rows.unionByName(sent).repartition(stripes, "stripe").sortWithinPartitions("stripe", "side", "cell", "id")
        return laid.mapInArrow(run(near), f"query_id long, {index.key} long, similarity double").filter(F.col("similarity") >= least)

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), index.key)

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)

    full = first(found(asked, True)).filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("last"))
    limited = asked.join(full, "query_id", "left").select("query_id", "query", F.coalesce("last", "floor").alias("floor"))
    return first(found(limited, False))
