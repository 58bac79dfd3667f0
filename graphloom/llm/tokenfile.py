"""Token-id files with a minimal perfect hash index for keyed access.

A token file is a folder of Parquet files, so that any store Spark can write holds it
and a lost task leaves nothing behind. Each row is one shard: a run of documents in
ascending key order with

* keys, ends     int64 key and running id count of each document,
* payload        the raw ids of all its documents (uint16 if the vocabulary allows, else uint32),
* displace, fingerprint, first, count   a minimal perfect hash of its distinct keys.

A key's hash picks a bucket, the bucket's displacement gives its slot, and the slot
stores a 32-bit fingerprint (so that an absent key is told apart) and the place of the
key's documents, hence their offsets: constant time for a key, whatever the shard's size.
Shards hold contiguous key ranges, so a key finds its shard by the manifest's bounds.

Defined results: a null text has only the end id; repeated keys stay separate documents,
ordered by their ids, and a lookup returns them all; documents with a null key come
first and only scans return them; an empty table gives a file without shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import mix64

U32, U64, I64 = "<u4", np.uint64, "<i8"
SHARD = (
    "shard int, n_docs long, n_ids long, first_key long, last_key long, wide boolean, keys binary, ends binary, "
    "payload binary, displace binary, fingerprint binary, first binary, count binary"
)
#: Keys of a bucket on average; displacements tried before another seed is taken.
BUCKET, TRIES = 4, 1 << 16
NULL_KEY = np.iinfo(np.int64).min
#: Shards of a file; beyond so many they grow, so that the manifest (one row each) stays small enough to send around.
MAX_SHARDS = 1 << 18


# --- minimal perfect hash -----------------------------------------------------
def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF))


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix64(h ^ (d.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95)) % U64(n)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements with the seed in front, slot of each key) for distinct keys.

    Buckets are placed from the largest down: the first displacement that sends all keys
    of a bucket to free slots. A bucket of one key takes the next free slot directly,
    stored as a negative number.
    """
    n = len(keys)
    buckets = max(1, -(-n // BUCKET))
    for seed in range(256):
        h = _hash(keys, seed)
        bucket = (h % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        free, slot, displace = np.ones(n, bool), np.full(n, -1), np.zeros(buckets, I64)
        for k in np.argsort(-sizes, kind="stable"):
            size = sizes[k]
            if size < 2:
                break
            own = order[starts[k] : starts[k] + size]
            for low in range(0, TRIES, 128):
                d = np.arange(low, low + 128)[:, None]
                at = _slots(h[own], d, n)
                fit = free[at].all(1)
                if fit.any():
                    at_sorted = np.sort(at, 1)
                    fit &= (at_sorted[:, 1:] != at_sorted[:, :-1]).all(1)
                if fit.any():
                    i = int(np.argmax(fit))
                    slot[own], displace[k] = at[i], low + i
                    free[at[i]] = False
                    break
            else:
                break
        single = np.flatnonzero(sizes == 1)
        if (slot[sizes[bucket] > 1] < 0).any():
            continue
        left = np.flatnonzero(free)[: len(single)]
        slot[order[starts[single]]] = left
        displace[single] = -1 - left
        return np.concatenate([np.array([seed], I64), displace]), slot
    raise ValueError("no perfect hash was found; are the keys distinct?")


def mph_slots(displace: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Slot of each key; of an absent key any slot."""
    h = _hash(keys, int(displace[0]))
    d = displace[1:][(h % U64(len(displace) - 1)).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(U64) ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype(U32)


# --- writing ------------------------------------------------------------------
def _shard(shard: int, keys: list, ids: list[bytes], wide: bool) -> dict:
    key = np.array([NULL_KEY if k is None else k for k in keys], I64)
    ends = np.cumsum([len(x) // 4 for x in ids]).astype(I64)
    known = np.array([k is not None for k in keys])
    distinct, first, count = np.unique(key[known], return_index=True, return_counts=True)
    first = first + int((~known).sum())
    displace, slot = build_mph(distinct) if len(distinct) else (np.zeros(1, I64), np.empty(0, np.int64))
    back = np.empty(len(distinct), np.int64)
    back[slot] = np.arange(len(distinct))
    payload = np.frombuffer(b"".join(ids), U32)
    return {
        "shard": shard, "n_docs": len(keys), "n_ids": int(ends[-1]), "wide": wide,
        "first_key": int(distinct[0]) if len(distinct) else None, "last_key": int(distinct[-1]) if len(distinct) else None,
        "keys": key.tobytes(), "ends": ends.tobytes(), "payload": (payload if wide else payload.astype("<u2")).tobytes(),
        "displace": displace.tobytes(), "fingerprint": fingerprints(distinct)[back].tobytes(),
        "first": first[back].astype(U32).tobytes(), "count": count[back].astype(U32).tobytes(),
    }


def _writer(wide: bool):
    def run(batches):
        at, keys, ids, schema = None, [], [], None
        for batch in batches:
            for shard, key, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != at and keys:
                    yield _row(_shard(at, keys, ids, wide))
                    keys, ids = [], []
                at = shard
                keys.append(key)
                ids.append(value)
        if keys:
            yield _row(_shard(at, keys, ids, wide))

    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = pa.schema([(n, types[t]) for n, t in (x.split() for x in SHARD.split(", "))])

    def _row(row):
        return pa.RecordBatch.from_pylist([row], schema=fields)

    return run


def bounds(docs: DataFrame, key: str, size: str, shard_bytes: int) -> list[int]:
    """First keys of all shards but the first, so that shards are runs of keys of about equal bytes of text."""
    total = docs.agg(F.sum(F.octet_length(size))).first()[0] or 0
    n = min(MAX_SHARDS, -(-total // shard_bytes))
    if n < 2:
        return []
    cut = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    return sorted(set(cut))


def write(docs: DataFrame, path: str, key: str, ids: str, cuts: list[int], vocabulary_size: int) -> None:
    """Write the token file of documents (key, ids as little-endian uint32 BINARY) with shards cut at `cuts`."""
    edges = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def shard_of(keys: pa.Array) -> pa.Array:
        k = keys.fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, k, side="right").astype(np.int32))

    rows = docs.select(shard_of(F.col(key).cast("long")).alias("shard"), F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    shards = rows.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "key", "ids")
    out = shards.mapInArrow(_writer(vocabulary_size > 1 << 16), SHARD)
    out.write.option("compression", "zstd").option("parquet.block.size", 1 << 24).parquet(path)


# --- reading ------------------------------------------------------------------
def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: shard, bounds of its keys and base, the ids of all shards before it."""
    rows = spark.read.schema(SHARD).parquet(path).select("shard", "n_docs", "n_ids", "first_key", "last_key")
    base, out = 0, []
    for r in rows.orderBy("shard").toLocalIterator():  # as many rows as shards
        out.append((*r, base))
        base += r["n_ids"]
    return spark.createDataFrame(out, "shard int, n_docs long, n_ids long, first_key long, last_key long, base long")


class Shard:
    """A shard's row, opened."""

    def __init__(self, row: dict):
        self.keys, self.ends = np.frombuffer(row["keys"], I64), np.frombuffer(row["ends"], I64)
        self.payload = np.frombuffer(row["payload"], U32 if row["wide"] else "<u2")
        self.displace, self.fingerprint = np.frombuffer(row["displace"], I64), np.frombuffer(row["fingerprint"], U32)
        self.first, self.count = np.frombuffer(row["first"], U32), np.frombuffer(row["count"], U32)

    @property
    def nulls(self) -> int:
        """Documents without a key; they come first."""
        return len(self.keys) - int(self.count.sum())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key by the hash index; no documents for an absent key."""
        n = len(self.fingerprint)
        if not n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = mph_slots(self.displace, n, keys)
        hit = self.fingerprint[slot] == fingerprints(keys)
        return self.first[slot].astype(np.int64), np.where(hit, self.count[slot], 0).astype(np.int64)

    def ids(self, doc: int) -> tuple[int, bytes]:
        """(ids before it in the shard, its ids as little-endian uint32)."""
        low = int(self.ends[doc - 1]) if doc else 0
        return low, self.payload[low : self.ends[doc]].astype(U32).tobytes()


READ = "key long, start long, ids binary"
_READ = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _rows(shard: Shard, docs, base: int):
    nulls = shard.nulls
    for low in range(0, len(docs), 1024):
        out = [(None if d < nulls else int(shard.keys[d]), *shard.ids(int(d))) for d in docs[low : low + 1024]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] + base for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
            schema=_READ,
        )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents: key, start (ids of all documents before it), ids. Each key is looked up in its shard's index."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                nulls = shard.nulls
                keys = np.unique(shard.keys[nulls:])
                first, count = shard.find(keys)
                docs = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield from _rows(shard, np.concatenate([np.arange(nulls), docs]), row["base"])

    shards = spark.read.schema(SHARD).parquet(path).join(F.broadcast(manifest(spark, path).select("shard", "base")), "shard")
    return shards.mapInArrow(run, READ)


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """Documents of the distinct keys in the first column of `keys`: key, start, ids; absent and null keys give none."""
    spark = keys.sparkSession
    table = manifest(spark, path)
    starts = [(r["first_key"], r["shard"]) for r in table.collect() if r["first_key"] is not None]  # one per shard
    firsts, shards = np.array([s[0] for s in starts], np.int64), np.array([-1, *(s[1] for s in starts)], np.int32)

    @F.arrow_udf("int")
    def shard_of(x: pa.Array) -> pa.Array:
        return pa.array(shards[np.searchsorted(firsts, x.to_numpy(zero_copy_only=False), side="right")])

    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).dropna().distinct()
    wanted = wanted.select(shard_of("key").alias("shard"), "key").filter("shard >= 0")
    files = spark.read.schema(SHARD).parquet(path).join(F.broadcast(table.select("shard", "base")), "shard")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            row = right.to_pylist()[0]
            shard = Shard(row)
            first, count = shard.find(np.sort(left.column("key").to_numpy()))
            docs = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out = list(_rows(shard, docs, row["base"]))
        return pa.Table.from_batches(out, schema=_READ)

    return wanted.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(run, READ)
