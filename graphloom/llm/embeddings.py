"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length with cosine >= c lie within e = sqrt(2 - 2c) of each other. The
vectors are sorted in grid order: by the cells of width e of their coordinates on the
leading principal axes, lexicographically, so that near vectors come near in the
sequence. The sequence is cut into blocks by a range partitioning. Blocks are skipped if
their bounding boxes or their balls are further apart than e; a box has a further side
for the length of what the axes leave of a vector, as the distance of two vectors is at
least that of their projections together with the difference of these lengths. The others are
joined by recursion on intervals: an interval pair whose boxes are too far apart ends, a
large one is halved, a small one is compared exactly by a product in double precision.
The axes are fitted on a bounded sample and only affect what is skipped: any rotation
gives the same links. Blocks travel by groups of neighbours: a task gets two groups and
joins the pairs of their blocks. Vectors spread evenly over many dimensions leave nothing to skip;
vectors in groups let most blocks be skipped.

Bit-identical vectors are one class with a count, and links are between classes, so ids
play no part in them. A task returns one row per class with a link (links counted, and
its root in a forest of the links), never the pairs.

Defined results: vectors that are null, zero or hold null or non-finite components link
with nothing; vectors of fewer dimensions than the longest count as filled up with
zeros; every row is a vector of its own, also with an id seen before; rows with a null
id take no part and have null results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, forget, materialize, roots, shuffle_partitions

#: Principal axes of the grid; vectors of the sample they are fitted on.
AXES, SAMPLE = 8, 4096
#: Vectors of a block, and of an interval that is compared at once.
BLOCK, LEAF = 4096, 256
#: Bytes of the vectors of a group of blocks, of which a task holds two.
GROUP_BYTES = 32 << 20
#: Axes whose cell a block that is half full doesn't go beyond.
CUT = 3
#: Relative room for rounding in the distance bounds, so that no link is skipped.
ROOM = 1e-9


def unit(values) -> np.ndarray | None:
    """The vector over its length in double precision, or None if it can't link."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], float)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return None if not top else (x / top) / np.sqrt(((x / top) ** 2).sum())


def _prepare(batches):
    for batch in batches:
        vectors = [unit(v) for v in batch.column(1).to_pylist()]
        data = [None if v is None else v.tobytes() for v in vectors]
        # trailing zeros don't tell vectors apart
        hashes = [None if v is None else hashlib.blake2b(np.trim_zeros(v, "b").tobytes(), digest_size=16).digest() for v in vectors]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hashes, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "same", "unit"]
        )


def principal_axes(x: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Leading orthonormal axes (columns) of a sample."""
    if not len(x):
        return np.zeros((0, axes))
    centred = x - x.mean(0)
    _, v = np.linalg.eigh(centred.T @ centred)
    return v[:, ::-1][:, :axes]


def placed(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes, and the length of the rest: nothing is nearer in them than it is."""
    y = x @ axes
    rest = np.sqrt(np.maximum((x * x).sum(1) - (y * y).sum(1), 0))
    return np.concatenate([y, rest[:, None]], axis=1)


# --- joining intervals ----------------------------------------------------------
def _boxes(y: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    return y[low:high].min(0), y[low:high].max(0)


def box_gap(a, b) -> float:
    """Squared distance between two boxes."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((gap * gap).sum())


def interval_pairs(ya: np.ndarray, yb: np.ndarray, same: bool, reach: float):
    """Pairs of intervals (a from, a to, b from, b to) that may hold vectors within `reach` (squared)."""
    stack = [(0, len(ya), 0, len(yb))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 == a1 or b0 == b1 or same and b1 <= a0:
            continue
        if box_gap(_boxes(ya, a0, a1), _boxes(yb, b0, b1)) > reach:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            yield a0, a1, b0, b1
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [(m, a1, b0, b1), (a0, m, b0, b1)]
        else:
            m = (b0 + b1) // 2
            stack += [(a0, a1, m, b1), (a0, a1, b0, m)]


def block_links(xa, xb, ya, yb, counts_a, counts_b, same: bool, cosine: float):
    """(links of each row of a, links of each row of b, roots over the rows of a and then b)."""
    reach = (2 - 2 * cosine) * (1 + ROOM) + ROOM
    n, m = len(xa), len(xb)
    la, lb = np.zeros(n, np.int64), np.zeros(m, np.int64)
    left, right = [], []
    for a0, a1, b0, b1 in interval_pairs(ya, yb, same, reach):
        near = xa[a0:a1] @ xb[b0:b1].T >= cosine
        if same:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        i, j = np.nonzero(near)
        if len(i):
            i, j = i + a0, j + b0
            la += np.bincount(i, counts_b[j], n).astype(np.int64)
            lb += np.bincount(j, counts_a[i], m).astype(np.int64)
            r = roots(n + m, i, j + (0 if same else n))
            live = np.flatnonzero(r != np.arange(n + m))
            left.append(live)
            right.append(r[live])
            if sum(map(len, left)) > 4 * (n + m):
                r = roots(n + m, np.concatenate(left), np.concatenate(right))
                live = np.flatnonzero(r != np.arange(n + m))
                left, right = [live], [r[live]]
    r = roots(n + m, np.concatenate(left), np.concatenate(right)) if left else np.arange(n + m)
    return la, lb, r


BLOCKS = "block long, n int, classes binary, counts binary, units binary, low binary, high binary, ball binary"


def _blocker(axes: np.ndarray):
    def run(batches):
        ids, counts, units, last = [], [], [], b""
        number = TaskContext.get().partitionId() << 24

        def block():
            x = np.frombuffer(b"".join(units)).reshape(len(units), -1)
            low, high = _boxes(placed(x, axes), 0, len(x))
            centre = x.mean(0)
            ball = np.append(centre, np.sqrt(((x - centre) ** 2).sum(1).max()))
            row = [number, len(x), np.array(ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), *[v.tobytes() for v in (x, low, high, ball)]]
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for one, count, value, cell in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if len(ids) == BLOCK or 2 * len(ids) >= BLOCK and cell[:CUT] != last:
                    yield block()
                    number += 1
                    ids, counts, units = [], [], []
                ids.append(one)
                counts.append(count)
                units.append(value)
                last = cell[:CUT]
        if ids:
            yield block()

    return run


def _joiner(axes: np.ndarray, cosine: float):
    """Links of the pairs of two groups of blocks, whose blocks come ahead of them."""

    def linked(x, y, same: bool) -> pa.RecordBatch:
        (ra, ca, xa), (rb, cb, xb) = x, y
        la, lb, root = block_links(xa, xb, placed(xa, axes), placed(xb, axes), ca, cb, same, cosine)
        if same:
            ids, links, root = ra, la + lb, root[: len(ra)]
        else:
            ids, links = np.concatenate([ra, rb]), np.concatenate([la, lb])
        live = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[live]), pa.array(links[live]), pa.array(ids[root][live])], names=["class", "links", "root"])

    def run(batches):
        current, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if (r["g"], r["h"]) != current:
                    current, held = (r["g"], r["h"]), {}
                if r["side"] == 0:
                    held[r["block"]] = np.frombuffer(r["classes"], "<i8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["units"]).reshape(r["n"], -1)
                else:
                    yield linked(held[r["block"]], held[r["other"]], r["block"] == r["other"])

    return run


def met(blocks: DataFrame, pairs: DataFrame, group: int) -> DataFrame:
    """g, h, side, block, other, n, classes, counts, units: for each two groups of `group` neighbouring blocks with a pair, the blocks of their pairs (side 0), then the pairs (side 1).

    A block goes once to a group that it meets, not once to each block of that group.
    """
    of = lambda c: F.floor(F.shiftright(c, 24) / group).cast("long")
    asked = pairs.select(F.least(of("block"), of("other")).alias("g"), F.greatest(of("block"), of("other")).alias("h"), "block", "other")
    data = [F.col(c) for c in ("n", "classes", "counts", "units")]
    needed = asked.select("g", "h", "block").union(asked.select("g", "h", "other")).distinct()
    sent = needed.join(blocks, "block").select("g", "h", F.lit(0).alias("side"), "block", F.lit(None).cast("long").alias("other"), *data)
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("n", "classes", "counts", "units")]
    return sent.unionByName(asked.select("g", "h", F.lit(1).alias("side"), "block", "other", *none))


def group_size(n: int, tasks: int, width: int) -> int:
    """Blocks of a group: GROUP_BYTES at most, and few enough for each task to have two groups to join."""
    return max(1, min(GROUP_BYTES // max(1, BLOCK * width * 8), n // max(1, int(np.sqrt(2 * tasks)))))


def block_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """block, other (block <= other): pairs of blocks that meet in a cell of the first axis or a neighbouring one, and that bounds don't rule out."""
    width = float(np.sqrt(2 - 2 * cosine))
    reach = width * width * (1 + ROOM) + ROOM

    @F.arrow_udf("array<int>")
    def first_cells(low: pa.Array, high: pa.Array) -> pa.Array:
        span = lambda v: int(np.floor(np.frombuffer(v.as_py())[0] / width))
        return pa.array([list(range(span(a), span(b) + 1)) for a, b in zip(low, high)], pa.list_(pa.int32()))

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x, y) -> bool:
            f = {k: (np.frombuffer(x[k]), np.frombuffer(y[k])) for k in ("low", "high", "ball")}
            if box_gap((f["low"][0], f["high"][0]), (f["low"][1], f["high"][1])) > reach:
                return False
            p, q = f["ball"]
            gap = np.sqrt(((p[:-1] - q[:-1]) ** 2).sum()) - p[-1] - q[-1]
            return bool(gap <= 0 or gap * gap <= reach)

        return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())])

    bounds = F.struct("low", "high", "ball")
    own = blocks.select("block", bounds.alias("a"), F.explode(first_cells("low", "high")).alias("cell"))
    wide = own.select(F.col("block").alias("other"), F.col("a").alias("b"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = own.join(wide, "cell").filter("block <= other").dropDuplicates(["block", "other"])
    return pairs.filter(near("a", "b")).select("block", "other")


def join(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """vec_id long, n_links long, component_id long, kept boolean: one row per vector."""
    spark = vectors.sparkSession
    longest = max(0, vectors.agg(F.max(F.size(vector))).first()[0] or 0)
    column = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), column.alias("v"))
    filled = F.when(F.size("v") < longest, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))).otherwise(F.col("v"))
    ready = materialize(rows.select("vec_id", filled.alias("v")).mapInArrow(_prepare, "vec_id long, same binary, unit binary"), "vectors")
    known = ready.filter("vec_id is not null and unit is not null")
    classes = known.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")  # numbers stay, as they are written
    total = classes.count()
    sample = classes.orderBy("same").limit(SAMPLE).select("unit").collect()  # a bounded sample
    axes = principal_axes(np.array([np.frombuffer(r[0]) for r in sample]).reshape(len(sample), longest))
    width = float(np.sqrt(2 - 2 * cosine))

    @F.arrow_udf("binary")
    def cells(units: pa.Array) -> pa.Array:
        x = np.array([np.frombuffer(u.as_py()) for u in units]).reshape(len(units), len(axes))
        c = np.floor(x @ axes / width).astype(np.int64) + 128
        return pa.array([row.tobytes() for row in c.astype(np.uint8)], pa.binary())  # bytes compare like the cells

    order = classes.select("class", "copies", "unit", cells("unit").alias("cells"))
    n = max(1, -(-total // BLOCK))
    ordered = order.repartitionByRange(n, "cells", "class").sortWithinPartitions("cells", "class").select("class", "copies", "unit", "cells")
    blocks = materialize(ordered.mapInArrow(_blocker(axes), BLOCKS), "vector-blocks")
    pairs = materialize(block_pairs(blocks, cosine), "vector-pairs")

    tasks = shuffle_partitions(spark)
    laid = met(blocks, pairs, group_size(n, tasks, longest)).repartition(tasks, "g", "h").sortWithinPartitions("g", "h", "side")
    found = laid.mapInArrow(_joiner(axes, cosine), "class long, links long, root long")
    found = materialize(found, "vector-links")
    forget(blocks, pairs)

    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    tops = components(found.select("class", "root"), "vector-components").withColumnRenamed("node", "class")
    named = classes.select("same", "class", "rep", "copies").join(linked, "class", "left").join(tops, "class", "left")
    named = named.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "rep", F.coalesce("root", "class").alias("top"))
    named = materialize(named, "vector-members")
    first = named.groupBy("top").agg(F.min("rep").alias("root"))  # the smallest id of each component
    named = named.join(first, "top").select("same", "links", "root")
    named = materialize(named, "vector-named")
    forget(classes, found, tops)
    out = ready.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("same")).alias("same")).join(named, "same", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
