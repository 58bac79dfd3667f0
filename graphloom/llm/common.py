"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents handed to numpy at a time inside a task; bounds the memory of a batch.
SLICE = 512

U64 = np.uint64


# --- shared storage ---------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand whole texts to Python in batches of few rows: a batch of long documents stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


# --- columns ----------------------------------------------------------------
def held_out(doc_id: Column | str) -> Column:
    """Fold 0 of 5 by crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def raw(text: Column | str) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


#: Bits of the one-hash filters below: megabytes, whatever the tables.
FILTER_BITS, WIDE_FILTER_BITS = 1 << 23, 1 << 25


def _filter_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits set for the values (0 to bits - 1) of the only column, made by bit_or on the executors."""
    h = hashes.columns[0]
    words = hashes.groupBy(F.shiftright(h, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{h}` & 63 as int))")).alias("bits"))
    table = np.zeros(bits >> 6, np.int64)
    got = words.toArrow()  # at most bits / 64 rows
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table.view(U64)


def _held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (table[(h >> U64(6)).astype(np.int64)] >> (h & U64(63)) & U64(1)).astype(bool)


def may_hold(ids: DataFrame, of: str, key: Column | str) -> Column:
    """False only for keys that are not in ids[of]: a filter of fixed size, put before a shuffle of wide rows.

    It has FILTER_BITS bits however many ids there are; when it fills up, more rows pass
    and the join behind it still decides.
    """
    table = key_filter(ids, of)

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        trim()
        return pa.array(key_held(table, h))

    return held(filter_place(key))


def filter_place(key: Column | str) -> Column:
    """The place of an integer key in the filter of may_hold()."""
    return F.pmod(F.xxhash64((F.col(key) if isinstance(key, str) else key).cast("long")), F.lit(FILTER_BITS))


def key_filter(ids: DataFrame, of: str) -> np.ndarray:
    """The filter of may_hold() for functions that read texts themselves, so that a task has one Python worker."""
    return _filter_table(ids.select(filter_place(of).alias("h")), FILTER_BITS)


def key_held(table: np.ndarray, places: pa.Array) -> np.ndarray:
    return _held(table, places.to_numpy(zero_copy_only=False).astype(U64))


def wide_filter(hashes: DataFrame, of: str) -> np.ndarray:
    """A filter of fixed size for the 64-bit hashes of a column, whose low 6 bits may hold something else."""
    bits = WIDE_FILTER_BITS
    return _filter_table(hashes.select(F.shiftright(of, 6).bitwiseAND(F.lit(bits - 1).cast("long")).alias("h")), bits)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False only for hashes that are not in the column of a wide filter."""
    return _held(table, h.view(U64) >> U64(6) & U64(WIDE_FILTER_BITS - 1))


def keep_held(hashes: DataFrame, of: str, values: str) -> Column:
    """An array column of 64-bit hashes without most of those that are not in hashes[of]; none that are get lost."""
    table = wide_filter(hashes, of)

    @F.arrow_udf("array<long>")
    def kept(arrays: pa.Array) -> pa.Array:
        trim()
        flat = arrays.flatten().to_numpy(zero_copy_only=False)
        ends = np.asarray(arrays.offsets)
        ok = passes(table, flat)
        at = np.concatenate([[0], np.cumsum(ok)])[ends - ends[0]].astype(np.int32)
        return pa.ListArray.from_arrays(at, flat[ok])

    return kept(values)


def slices(batch: pa.RecordBatch, size: int = SLICE):
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def by_bytes(texts: pa.Array, most: int):
    """Slices of BINARY texts of at most so many bytes, or of one text."""
    if len(texts):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield texts.slice(at, to - at)
            at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of BINARY texts one after another, start of each and the end) without a copy."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer else np.empty(0, np.uint8)
    return data, ends - ends[0]


def binary_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """BINARY values of an array, cut at places in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


# --- hashing ----------------------------------------------------------------
def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Masks of the first 0 to 8 bytes of a little-endian integer; bytes of a word that are hashed by arrays.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
SHORT_WORD = 64


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces [start, stop) of an array of bytes; equal bytes, equal hashes."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = stops - starts
    h = mix64((eights[starts] & _MASKS[np.minimum(size, 8)]) + (size.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(size > 8)
    for k in range(8, SHORT_WORD, 8):
        if not len(left):
            return h
        part = eights[starts[left] + k] & _MASKS[np.minimum(size[left] - k, 8)]
        h[left] = mix64(h[left] * U64(0xD1342543DE82EF95) + part)
        left = left[size[left] > k + 8]
    if len(left):
        import xxhash

        h[left] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(starts[left].tolist(), stops[left].tolist())]
    return h


class HashTable:
    """Numbers 0, 1, ... of distinct 64-bit hashes in the order they came, by open addressing."""

    def __init__(self, bits: int = 16):
        self.keys, self.numbers, self.count = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or the free one where it would be."""
        last = U64(len(self.keys) - 1)
        slot = (h & last).astype(np.int64)
        left = np.flatnonzero((self.numbers[slot] >= 0) & (self.keys[slot] != h))
        while len(left):
            slot[left] = (slot[left] + 1) & int(last)
            left = left[(self.numbers[slot[left]] >= 0) & (self.keys[slot[left]] != h[left])]
        return slot

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for those that aren't there."""
        return self.numbers[self._slots(h)]

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        bits = len(self.keys).bit_length() - 1
        if 2 * (self.count + len(h)) > len(self.keys):
            old = np.empty(self.count, U64)
            full = self.numbers >= 0
            old[self.numbers[full]] = self.keys[full]
            h = np.concatenate([old, h])
            self.__init__(max(bits + 1, (4 * len(h)).bit_length()))
        number = np.arange(self.count, self.count + len(h))
        self.count += len(h)
        while len(h):
            slot = self._slots(h)
            _, first = np.unique(slot, return_index=True)  # one of those that want a slot gets it
            self.keys[slot[first]], self.numbers[slot[first]] = h[first], number[first]
            h, number = np.delete(h, first), np.delete(number, first)


_CACHES: dict[str, object] = {}


def cache(name: str, make):
    """A worker's cache of that name; what others hold is let go, as workers go from stage to stage."""
    if name not in _CACHES:
        release()
        _CACHES[name] = make()
    return _CACHES[name]


def release() -> None:
    """Let go of the worker's caches, and give their memory back to the machine."""
    if not _CACHES:
        return
    _CACHES.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free back to the machine: workers live on through all stages, and what one needed counts in the next."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def trimmed(run):
    """A function over batches that gives back what is free when its task ends."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Bytes of text whose words are hashed at once (a longer text is read whole).
TEXT_BYTES = 1 << 20


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and at the end) of the words of texts: what stands between ASCII white space."""
    release()
    n, solid = len(data), ~BLANK[data]
    change = np.ones(n + 1, bool)
    np.not_equal(solid[1:], solid[:-1], out=change[1:n])
    change[bounds] = True
    cuts = np.flatnonzero(change)
    first = solid[cuts[:-1]]
    starts = cuts[:-1][first]
    return starts, cuts[1:][first], np.searchsorted(starts, bounds)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of BINARY texts, words before each text and at the end); with `lower`, A-Z count as a-z."""
    data, bounds = bytes_of(texts)
    starts, stops, ends = split_words(data, bounds)
    return hash_words(LOWER.take(data) if lower else data, starts, stops), ends


def shingle_sets(texts: pa.Array, size: int):
    """Of each BINARY text, the sorted distinct hashes of its runs of `size` words, or of the whole of fewer words."""
    for part in by_bytes(texts, TEXT_BYTES):
        words, ends = word_hashes(part)
        every = shingle_hashes(words, size)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield np.unique(every[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, in order; of the whole sequence when it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, U64)
    width = min(size, n)
    h = np.full(n - width + 1, U64(0x9E3779B97F4A7C15 * (width + 1) & 0xFFFFFFFFFFFFFFFF))
    for k in range(width):
        h = mix64(h + words[k : n - width + 1 + k])
    return h


# --- union-find and components ------------------------------------------------
def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for nodes 0..n-1 and links a-b."""
    parent = np.arange(n)
    while len(a):
        lo, hi = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        live = lo != hi
        a, b, lo, hi = a[live], b[live], lo[live], hi[live]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def forest(child: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that isn't its own root."""
    nodes, inv = np.unique(np.concatenate([child, other]), return_inverse=True)
    m = len(child)
    r = roots(len(nodes), inv[:m], inv[m:])
    live = r != np.arange(len(nodes))
    return nodes[live], nodes[r[live]]


#: Links held at once by a task that contracts its partition; memory follows this, not the partition.
LINKS_AT_ONCE = 1_000_000


def _contract(batches):
    a, b, held = [], [], 0

    def shrink():
        x, y = forest(np.concatenate(a), np.concatenate(b))
        return [x], [y], len(x)

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > LINKS_AT_ONCE and len(a) > 1:
            a, b, left = shrink()
            held = left // 2  # what couldn't shrink doesn't count again and again
    if a:
        a, b, _ = shrink()
        if len(a[0]):
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(b[0], pa.int64())], names=["node", "root"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (two integer columns): node long, root long, for nodes that are not their own root.

    root is the smallest node of the component. Each round contracts the links by
    union-find inside the partitions of their larger node, then lets every node skip
    to its root's root; both passes are linear in the links and no component is ever
    gathered in one task. Rounds follow the logarithm of the depth.
    """
    x, y = links.columns[:2]
    cur = links.select(
        F.greatest(F.col(x), F.col(y)).cast("long").alias("node"), F.least(F.col(x), F.col(y)).cast("long").alias("root")
    ).filter("node <> root")
    n = shuffle_partitions(links.sparkSession)
    old: list[DataFrame] = []
    while True:
        trees = materialize(cur.repartition(n, "node").mapInArrow(trimmed(_contract), "node long, root long"), name)
        for t in old:
            forget(t)
        stats = trees.agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes")).first()
        up = materialize(
            trees.select(F.col("root").alias("mid")).distinct().join(
                trees.groupBy(F.col("node").alias("mid")).agg(F.min("root").alias("top")), "mid"
            ),
            f"{name}-up",
        )
        if stats["rows"] == stats["nodes"] and up.isEmpty():
            forget(up)
            return trees
        jumped = trees.join(up, trees["root"] == up["mid"], "left").select(
            "node", F.coalesce("top", "root").alias("root")
        )
        cur = jumped.unionByName(up.select(F.col("mid").alias("node"), F.col("top").alias("root")))
        old = [trees, up]
