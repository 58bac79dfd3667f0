"""Exact nearest neighbours by a block matrix join of int8 product tiles.

A vector x is s * c + r with whole numbers c from -127 to 127, a scale s and a rest r. The
distance of two vectors differs from that of their codes by at most the lengths of both
rests. The products of a block of query codes and a tile of candidate codes are one matrix
product of whole numbers, exact in single precision, and give a lower and an upper bound
of every distance. Pairs whose lower bound is not above the query's k-th upper bound, nor
above its k-th distance so far, are computed again on the original vectors in double
precision and go to the query's heap. Nothing else is left out, so the result is exact.

Defined results: vectors that are null, zero or hold null or non-finite components, and
rows with a null id, take no part; shorter vectors are filled up with zeros; each row is a
vector of its own, also with an id seen before: a query meets all rows but itself, and two
rows of one id are two queries (with the same query_id); ties go to the smaller id; with
fewer candidates all are returned; an empty table gives an empty result. Distances that
double precision cannot hold are infinite and come last.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import forget, materialize
from graphloom.llm.searching import Best, blocks, classes, merged, others, prepare, search

#: Candidates of a tile; queries it meets at once; pairs computed again at once; numbers of a product that single precision holds.
TILE, QUERIES, PAIRS, EXACT = 4096, 512, 1 << 16, 1024
#: Relative room for rounding in the bounds.
ROOM = 1e-12


def quantised(x: np.ndarray) -> SimpleNamespace:
    """codes int8, scale, squared length of the coded vectors, and at least the length of the rests."""
    x = x.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)
        codes = np.clip(np.rint(x / scale[:, None]), -127, 127)
        rest = x - codes * scale[:, None]
        return SimpleNamespace(
            codes=codes.astype(np.int8), scale=scale, square=scale * scale * (codes * codes).sum(1),
            rest=np.sqrt((rest * rest).sum(1)) * (1 + ROOM) + np.abs(x).max(1) * ROOM,
        )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: sums over EXACT numbers stay below 2**24."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def bounds(a: SimpleNamespace, b: SimpleNamespace, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the distances of all vectors of a from rows of b."""
    with np.errstate(over="ignore", invalid="ignore"):
        both = a.square[:, None] + b.square[None, rows]
        square = both - 2 * (a.scale[:, None] * b.scale[None, rows]) * products(a.codes, b.codes[rows])
        slack = a.rest[:, None] + b.rest[None, rows]
        low = np.sqrt(np.maximum(square - ROOM * both, 0)) - slack
        high = np.sqrt(np.maximum(square, 0) + ROOM * both) + slack
    return np.nan_to_num(low, nan=-np.inf, posinf=-np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of two arrays, squares added in the order of the numbers."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for x, y in zip(a.T.astype(float), b.T.astype(float)):
            total += (x - y) ** 2
        return np.sqrt(total)


def _build(table: SimpleNamespace) -> SimpleNamespace:
    table.quantised = quantised(table.x)
    return table


def _searcher(keep: int):
    def near(table: SimpleNamespace, q: SimpleNamespace, best: Best, at: int) -> None:
        part = slice(at, min(at + QUERIES, len(q.x)))
        codes = quantised(q.x[part])
        for start in range(0, len(table.x), TILE):
            rows = slice(start, min(start + TILE, len(table.x)))
            low, high = bounds(codes, table.quantised, rows)
            limit = best.last[part]
            if high.shape[1] >= keep:
                limit = np.minimum(limit, np.partition(high, keep - 1, axis=1)[:, keep - 1])
            i, j = np.nonzero(low <= limit[:, None])
            for k in range(0, len(i), PAIRS):
                query, row = i[k : k + PAIRS] + at, j[k : k + PAIRS] + start
                best.offer(query, distances(q.x[query], table.x[row]), row, table, (q.same[query] == table.same[row]).all(1))

    def run(table: SimpleNamespace, q: SimpleNamespace):
        best = Best(len(q.x), keep)
        for at in range(0, len(q.x), QUERIES):
            near(table, q, best, at)
        return best.batch(q.same)

    return run


def nearest(vectors: DataFrame, k: int, asked: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score double: the k nearest other rows of each row for which `asked`, over `id`, holds."""
    rows, dim, kind = prepare(vectors, key, vector, F.lit(0), lambda x: x, zero=False)
    rows = materialize(rows, "neighbour-vectors")
    known = materialize(classes(rows, k + 1), "neighbour-classes")
    total, row_bytes = known.count(), dim * (int(kind[-1]) + 1) + 64 + 8 * (k + 1)
    queries = rows.filter(asked).select("same", "label", F.expr("cast(array() as array<long>)").alias("values"), "v").dropDuplicates(["same"])
    found = search(blocks(known, row_bytes), blocks(queries, row_bytes), total, row_bytes, kind, dim, _build, _searcher(k + 1))
    best = materialize(merged(found, k + 1).select("same", "best"), "neighbour-best")
    forget(known)
    mine = rows.filter(asked).select("id", "same").join(best, "same")
    return mine.select(F.col("id").alias("query_id"), F.posexplode(others("best", "id", k)).alias("place", "n")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.key").alias("score")
    )
