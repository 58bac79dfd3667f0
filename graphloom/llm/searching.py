"""What the searches over vectors share: classes of equal vectors, blocks, stripes, and heaps of the best.

Equal vectors are one class with the smallest few of its ids, which is all that a search
for the best few can need of it, so a group of copies costs one row. Classes are packed
into blocks of bounded size and dealt to stripes of bounded size; every stripe also
gets all blocks of queries. A task therefore holds one stripe, reads the queries block by
block, and gives back the best few of each query in this stripe, which a window merges.
"""

from __future__ import annotations

import hashlib
import heapq
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import shuffle_partitions

#: Bytes of a block and of a stripe, and rows that a stripe has at least if there are several.
BLOCK_BYTES, STRIPE_BYTES, LEAST_ROWS = 1 << 17, 1 << 26, 1024

BLOCKS = "number long, n int, same binary, labels binary, counts binary, values binary, vectors binary"
FOUND = "same binary, cap long, key double, id long, own boolean"


# --- vectors and their classes ------------------------------------------------------
def prepare(vectors: DataFrame, key: str, vector: str, label: Column, change, zero: bool) -> tuple[DataFrame, int, str]:
    """(id long, label int, same binary, v binary of rows that take part; numbers of a vector; their type).

    Null vectors and those with null or non-finite components take no part, nor do zero
    ones unless `zero`; shorter vectors are filled up with zeros; change: see the callers.
    Rows with a null id take no part.
    """
    dim = max(1, vectors.agg(F.max(F.size(vector))).first()[0] or 0)
    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector].dataType.containsNull)
    kind = "<f4" if single else "<f8"  # of double vectors, nothing is rounded
    v = F.col(vector).cast("array<double>")
    filled = F.when(F.size(v) < dim, F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v)))).otherwise(v)
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("int").alias("label"), filled.alias("v"))

    def ready(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype("<i4")
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (zero | (x != 0).any(1))
            x = (change(x[ok]) + 0.0).astype(kind)  # no negative zeros
            labels, ids = labels[ok], batch.column(0).filter(pa.array(ok))
            data = [row.tobytes() for row in x]
            same = [hashlib.blake2b(d + n.tobytes(), digest_size=16).digest() for d, n in zip(data, labels)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels, pa.int32()), pa.array(same, pa.binary()), pa.array(data, pa.binary())], names=["id", "label", "same", "v"])

    return rows.filter("id is not null and label is not null and v is not null").mapInArrow(ready, "id long, label int, same binary, v binary"), dim, kind


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """same, label, v and the `keep` smallest ids of the rows of each class (an id as often as it is there)."""
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("same").orderBy("id"))).filter(F.col("k") <= keep)
    return ranked.groupBy("same").agg(F.first("label").alias("label"), F.sort_array(F.collect_list("id")).alias("values"), F.first("v").alias("v"))


def blocks(table: DataFrame, row_bytes: int) -> DataFrame:
    """Rows same, label, values array<long>, v packed into blocks."""
    most = max(1, BLOCK_BYTES // row_bytes)

    def pack(number, rows):
        same, labels, values, v = zip(*rows)
        counts = np.array([len(x) for x in values], "<i4")
        flat = np.array([x for row in values for x in row], "<i8")
        cells = [number, len(rows), b"".join(same), np.array(labels, "<i4").tobytes(), counts.tobytes(), flat.tobytes(), b"".join(v)]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches):
        number, rows = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows.append(row)
                if len(rows) == most:
                    yield pack(number, rows)
                    number, rows = number + 1, []
        if rows:
            yield pack(number, rows)

    return table.select("same", "label", "values", "v").mapInArrow(run, BLOCKS)


def search(candidates: DataFrame, queries: DataFrame, total: int, row_bytes: int, kind: str, dim: int, build, best) -> DataFrame:
    """FOUND rows of every block of queries in every stripe of candidates: best(build(blocks of a stripe), block of queries).

    No join: the blocks of queries are copied to each stripe, and rows are sorted so that
    a stripe's candidates come before its queries.
    """
    spread = min(shuffle_partitions(candidates.sparkSession), -(-total // LEAST_ROWS))
    stripes = max(1, spread, -(-total * row_bytes // STRIPE_BYTES))
    dealt = candidates.withColumns({"stripe": F.pmod(F.xxhash64("number"), F.lit(stripes)).cast("int"), "kind": F.lit(0)})
    asked = queries.withColumns({"stripe": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))), "kind": F.lit(1)})

    def opened(r) -> SimpleNamespace:
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(r["counts"], "<i4"))]).astype(np.int64)
        return SimpleNamespace(
            same=np.frombuffer(r["same"], "<u8").reshape(-1, 2), labels=np.frombuffer(r["labels"], "<i4"), ends=ends,
            values=np.frombuffer(r["values"], "<i8"), x=np.frombuffer(r["vectors"], kind).reshape(-1, dim),
        )

    def joined(parts) -> SimpleNamespace:
        counts = np.concatenate([np.diff(p.ends) for p in parts])
        whole = {k: np.concatenate([getattr(p, k) for p in parts]) for k in ("same", "labels", "values", "x")}
        return SimpleNamespace(ends=np.concatenate([[0], np.cumsum(counts)]), **whole)

    def run(batches):
        current, parts, index = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["stripe"] != current:
                    current, parts, index = r["stripe"], [], None
                if r["kind"] == 0:
                    parts.append(opened(r))
                    continue
                if parts:
                    index, parts = build(joined(parts)), []
                if index is not None:
                    yield best(index, opened(r))

    columns = ["stripe", "kind", *[c.split()[0] for c in BLOCKS.split(", ")]]
    laid = dealt.select(columns).unionByName(asked.select(columns)).repartition(stripes, "stripe").sortWithinPartitions("stripe", "kind", "number")
    return laid.mapInArrow(run, FOUND)


def merged(found: DataFrame, keep: int) -> DataFrame:
    """The first rows of each (same, cap) over all stripes, by key, then id, as an array `best` of structs key, id, own."""
    order = Window.partitionBy("same", "cap").orderBy("key", "id", F.col("own").desc())
    first = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= keep)
    rows = F.array_sort(F.collect_list(F.struct("k", "key", "id", "own")))
    return first.groupBy("same", "cap").agg(rows.alias("best"))


def others(best: str, id_: str, most: int) -> Column:
    """The first entries of an array of merged() without the row itself: the first of its class that has its id."""
    own = F.array_position(F.transform(best, lambda x: x["own"] & (x["id"] == F.col(id_))), True)
    return F.slice(F.filter(best, lambda _, i: i + 1 != own), 1, most)


# --- the best of a block of queries in a stripe -----------------------------------------
class Best:
    """Of each of m queries, a heap of the `keep` first entries by (key, id)."""

    def __init__(self, m: int, keep: int):
        self.keep, self.heaps = keep, [[] for _ in range(m)]
        self.last = np.full(m, np.inf)  # key of the last entry of full heaps

    def offer(self, query: np.ndarray, keys: np.ndarray, rows: np.ndarray, table: SimpleNamespace, own: np.ndarray) -> None:
        """Entries for the ids of classes `rows`; of each query, no more classes than the heap holds are opened."""
        near = keys <= self.last[query]
        query, keys, rows, own = query[near], keys[near], rows[near], own[near]
        order = np.lexsort((table.values[table.ends[rows]], keys, query))
        query, keys, rows, own = query[order], keys[order], rows[order], own[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        for i in np.flatnonzero(rank < self.keep).tolist():
            heap, key = self.heaps[query[i]], -float(keys[i])
            for v in table.values[table.ends[rows[i]] : table.ends[rows[i] + 1]].tolist():
                entry = (key, -v, bool(own[i]))  # the last entry is on top; of equal entries the own one stays
                if len(heap) < self.keep:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                else:
                    break
        for q in np.unique(query).tolist():
            if len(self.heaps[q]) == self.keep:
                self.last[q] = -self.heaps[q][0][0]

    def batch(self, same: np.ndarray, caps: np.ndarray | None = None) -> pa.RecordBatch:
        """The entries as rows of FOUND; same: digests of the queries."""
        digests = [s.tobytes() for s in same]
        rows = [(digests[q], None if caps is None else int(caps[q]), -key, -v, own) for q, heap in enumerate(self.heaps) for key, v, own in heap]
        types = [pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
        cells = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["same", "cap", "key", "id", "own"])
