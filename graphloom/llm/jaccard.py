"""N-gram Jaccard join through a token-group matrix.

Documents are sets of word shingles; two link when 100 |A & B| >= per_cent |A | B|. Equal
sets are one class from the start. The rest runs in four steps, all linear in the
documents but for the groups that qualify:

1. Tokens. For sets of at most s shingles a link leaves D = 2s(100-p)/(100+p) shingles
   unshared at most. The shingles are dealt by hash to D + 1 parts and some more, so
   linked sets agree on 1 + extra whole parts at least; the sum of a part's hashes is a
   token. Sizes are dealt to classes, each with its own number of parts, and sets near a
   class's upper end have tokens in the next class too. Empty parts count as agreeing
   only when a set has more of them than the spare parts allow for.
2. Groups. Tokens of one set only are dropped, and so are the `extra` most frequent tokens
   of each set: of those that linked sets share, one stays in both (the prefix principle),
   and passages that very many documents have go. Each set joins the group of its most
   frequent token left, or a larger one that shares a token with it, dealt to blocks of
   bounded size: similar documents lie together.
3. Matrix. The distinct (token, group) pairs, each group's token union. Groups that
   share no token can't hold a link, as the overlap of any set with the other group's
   union is then below what a link needs. Pairs of groups that share one qualify.
4. Opening. For a qualifying pair, each set is held against the other group's union of
   shingles; sets whose overlap is under p % of their size are left out, and those that
   stay are compared exactly by products of 0/1 matrices over the shared shingles. A task
   gives a spanning forest of its links, no more rows than it has documents.

Components of these links, with copies put back, are the result. Nothing is dropped or
capped. Shingles are told apart by 64-bit hashes, equal sets by 128-bit ones.

Defined results: null texts and texts without words have no shingles and link with
nothing; fewer words than the shingle size make one shingle of the whole sequence; rows
with one id are one document; a row with a null id links with nothing and has a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import (
    U64,
    components,
    filter_place,
    forest,
    forget,
    keep_held,
    key_filter,
    key_held,
    materialize,
    mix64,
    raw,
    shingle_sets,
    shuffle_partitions,
    slices,
    trimmed,
)

#: Documents of a group's block; bounds what a task opens at once.
BLOCK = 256
#: Shingles of a set beyond which it counts for more than one in its block.
BLOCK_SIZE = 1024
#: Ratio of the largest to the smallest size in a class of sizes.
RATIO = 1.7
#: Columns of the 0/1 matrices multiplied at a time.
COLUMNS = 2048


# --- tokens -------------------------------------------------------------------
@functools.lru_cache(8)
def size_classes(per_cent: int) -> tuple[int, ...]:
    """Lower ends of the classes of set sizes; sets below the first link with equal sets only."""
    low = next(n for n in range(1, 1 << 20) if unshared(n, per_cent))
    ends = [low]
    while ends[-1] < 1 << 40 and len(ends) < 64:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RATIO)))
    return tuple(ends)


def unshared(size: int, per_cent: int) -> int:
    """Most shingles that linked sets of at most this size don't share."""
    return 2 * size * (100 - per_cent) // (100 + per_cent)


def set_tokens(shingles: np.ndarray, per_cent: int) -> np.ndarray:
    """Tokens of a set; linked, unequal sets share more of a label than its `extra`. The low 6 bits are the label."""
    n, ends = len(shingles), size_classes(per_cent)
    at = int(np.searchsorted(ends, n, side="right")) - 1
    out = []
    for label in (at, at + 1):
        if label < 0 or label > at and 100 * n < per_cent * ends[label]:
            continue
        parts, spare = parts_of(label, per_cent)[:2]
        salt = U64(0x9E3779B97F4A7C15 * (label + 1) & 0xFFFFFFFFFFFFFFFF)
        part = (mix64(shingles ^ salt) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]]))
        sums = np.add.reduceat(mix64(shingles + salt)[order], first)
        filled = sorted_part[first]
        place = mix64(np.arange(parts).astype(U64) + salt)
        mark = lambda h: (mix64(h) & ~U64(63)) | U64(label)  # noqa: B023, E731
        out.append(mark(sums ^ place[filled]))
        if parts - len(filled) > spare:
            out.append(mark(np.delete(place, filled)))
    return np.concatenate(out) if out else np.empty(0, U64)


def parts_of(label: int, per_cent: int) -> tuple[int, int, int]:
    """(parts, spare parts for empty ones, further extra parts) of a class of sizes."""
    most = unshared(size_classes(per_cent)[label + 1] - 1, per_cent)
    spare, extra = 1 + (most + 1) // 32, most // 2
    return most + 1 + spare + extra, spare, extra


def _signer(size: int, per_cent: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                counts, h1, h2, tokens = [], [], [], []
                for s in shingle_sets(part.column(1), size):
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    counts.append(len(s))
                    h1.append(digest[0])
                    h2.append(digest[1])
                    tokens.append(set_tokens(s, per_cent).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                    names=["doc", "n", "h1", "h2", "tokens"],
                )

    return run


def _token_ends(batches):
    """Of rows (cls, tokens): each token of a batch once, with the least and the greatest class that has it there."""
    for batch in batches:
        tokens = batch.column(1)
        sizes = np.diff(np.asarray(tokens.offsets))
        flat, cls = tokens.flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
        if not len(flat):
            continue
        order = np.argsort(flat, kind="stable")
        flat, cls = flat[order], cls[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        columns = [flat[first], np.minimum.reduceat(cls, first), np.maximum.reduceat(cls, first)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "low", "high"])


# --- opening groups -------------------------------------------------------------
def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)

    def place(sets, flat):
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    if not len(shared):
        return out
    (ra, ca), (rb, cb) = place(a, left), place(b, right)
    for low in range(0, len(shared), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            own = (c >= low) & (c < low + COLUMNS)
            m[r[own], c[own] - low] = 1
        out += x @ y.T
    return out


def group_links(a: list[np.ndarray], b: list[np.ndarray], per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (index in a, index in b) between two groups of sets."""
    keep = []
    for own, other in ((a, b), (b, a)):
        union = np.unique(np.concatenate(other))
        keep.append([i for i, s in enumerate(own) if 100 * np.isin(s, union, assume_unique=True).sum() >= per_cent * len(s)])
    if not keep[0] or not keep[1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = [a[i] for i in keep[0]], [b[i] for i in keep[1]]
    both = _overlaps(x, y).astype(np.int64)
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    i, j = np.nonzero(100 * both >= per_cent * (sizes - both))
    return np.array(keep[0])[i], np.array(keep[1])[j]


def _opener(per_cent: int):
    def links(docs, sides, sets):
        docs = np.array(docs)
        first = [k for k, s in enumerate(sides) if s == 0]
        second = [k for k, s in enumerate(sides) if s == 1] or first
        i, j = group_links([sets[k] for k in first], [sets[k] for k in second], per_cent)
        return forest(docs[np.array(first)[i]], docs[np.array(second)[j]]) if len(i) else (i, j)

    def run(batches):
        at, docs, sides, sets = None, [], [], []
        for batch in batches:
            for pair, side, doc, data in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if pair != at and docs:
                    yield from _pairs(*links(docs, sides, sets))
                    docs, sides, sets = [], [], []
                at = pair
                docs.append(doc)
                sides.append(side)
                sets.append(np.frombuffer(data, U64))
        if docs:
            yield from _pairs(*links(docs, sides, sets))

    return run


def _pairs(a, b):
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _members(table: np.ndarray, size: int):
    """doc and the shingles of its text, of rows (doc, text, place in the filter) that the filter holds."""

    def run(batches):
        for batch in batches:
            own = batch.filter(pa.array(key_held(table, batch.column(2))))
            for part in slices(own, 64):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column(1), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["doc", "shingles"])

    return run


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, per_cent: int = 90) -> DataFrame:
    """doc_id long, n_shingles long, component_id long (smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc"), raw(text).alias("text"))
    signed = materialize(rows.mapInArrow(trimmed(_signer(size, per_cent)), "doc long, n long, h1 long, h2 long, tokens array<long>"), "jaccard-sets")
    known = signed.filter("doc is not null and n > 0")
    classes = materialize(known.groupBy("h1", "h2").agg(F.min("doc").alias("rep")), "jaccard-classes")

    # tokens that at least two classes have; a class goes by its first hash
    tokens = known.filter(F.size("tokens") > 0).select(F.col("h1").alias("cls"), "tokens")
    # most tokens are single: no partial sums in hash maps, but each batch's are merged, which takes the frequent ones
    ends = tokens.mapInArrow(trimmed(_token_ends), "token long, low long, high long").repartition(4 * n, "token")
    ends = ends.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    often = materialize(ends.filter("low <> high").select("token"), "jaccard-often")
    fewer = tokens.select("cls", F.explode(keep_held(often, "token", "tokens")).alias("token")).distinct()
    shared = materialize(fewer.join(often, "token"), "jaccard-tokens")

    # without the most frequent tokens of each set
    sets = materialize(shared.groupBy("token").agg(F.count("*").alias("sets")), "jaccard-sets-of-tokens")
    label = F.col("token").bitwiseAND(F.lit(63).cast("long")).cast("int")
    extra = F.element_at(F.array(*[F.lit(parts_of(k, per_cent)[2]) for k in range(len(size_classes(per_cent)) - 1)]), label + 1)
    order = Window.partitionBy("cls", label).orderBy(F.desc("sets"), F.desc("token"))
    ranked = shared.join(sets, "token").withColumn("place", F.row_number().over(order)).filter(F.col("place") > extra)
    rare = materialize(ranked.select("cls", "token", "sets"), "jaccard-rare")
    left = rare.groupBy("token").agg(F.count("*").alias("classes")).filter("classes > 1").select("token")
    shared_rare = materialize(rare.join(left, "token"), "jaccard-left")

    # groups of similar classes, in blocks: each goes to its most frequent token, and then
    # to the largest group that any of its tokens leads to, so that near copies lie together
    best = F.max(F.struct("sets", "token")).alias("m")
    first = materialize(shared_rare.groupBy("cls").agg(best).select("cls", F.col("m.token").alias("first")), "jaccard-first")
    sizes = materialize(first.groupBy("first").agg(F.count("*").alias("size")), "jaccard-sizes")
    held = materialize(first.join(sizes, "first"), "jaccard-held")
    leads = shared_rare.join(held, "cls").groupBy("token").agg(F.max(F.struct("size", "first")).alias("lead"))
    leads = materialize(leads, "jaccard-leads")
    chosen = shared_rare.select("cls", "token").join(leads, "token").groupBy("cls").agg(F.max("lead").alias("m"))
    chosen = materialize(chosen.select("cls", F.col("m.first").alias("token")), "jaccard-chosen")
    counts = materialize(chosen.groupBy("token").agg(F.count("*").alias("docs")), "jaccard-counts")
    weight = F.element_at(F.array(*[F.lit(max(1.0, e / BLOCK_SIZE)) for e in size_classes(per_cent)[1:]]), label + 1)
    block = F.pmod(F.xxhash64("cls"), F.ceil(F.col("docs") * weight / F.lit(float(BLOCK))))
    grouped = materialize(chosen.join(counts, "token").select("cls", F.xxhash64("token", block).alias("grp")), "jaccard-groups")
    matrix = shared_rare.join(grouped, "cls").select("token", "grp").distinct()
    matrix = materialize(matrix, "jaccard-matrix")
    cross = (
        matrix.join(matrix.select("token", F.col("grp").alias("other")), "token").filter("grp < other").select("grp", "other").distinct()
    )
    alone = grouped.groupBy("grp").agg(F.count("*").alias("docs")).filter("docs > 1").select("grp", F.col("grp").alias("other"))
    pairs = cross.unionByName(alone).withColumn("pair", F.xxhash64("grp", "other"))
    sides = materialize(
        pairs.select("pair", F.lit(0).alias("side"), "grp").unionByName(
            pairs.filter("grp <> other").select("pair", F.lit(1).alias("side"), F.col("other").alias("grp"))
        ),
        "jaccard-pairs",
    )

    # shingles of the grouped documents, brought to each pair their group is in
    opened_groups = grouped.join(sides.select("grp").distinct(), "grp", "left_semi")
    opened_groups = opened_groups.join(classes, opened_groups["cls"] == classes["h1"]).select(F.col("rep").alias("doc"), "grp")
    opened_groups = materialize(opened_groups, "jaccard-opened")
    asked = rows.select("doc", "text", filter_place("doc").alias("place")).filter("place is not null")
    members = asked.mapInArrow(trimmed(_members(key_filter(opened_groups, "doc"), size)), "doc long, shingles binary").join(opened_groups, "doc")
    members = materialize(members.dropDuplicates(["doc", "shingles"]), "jaccard-members")
    opened = sides.join(members, "grp").select("pair", "side", "doc", "shingles")
    opened = opened.repartition(n, "pair").sortWithinPartitions("pair", "side", "doc")
    links = materialize(opened.mapInArrow(trimmed(_opener(per_cent)), "a long, b long"), "jaccard-links")
    # rows of one id are one document, whatever their texts: its classes belong together
    ends = F.struct("h1", "h2")
    several = known.groupBy("doc").agg(F.min(ends).alias("x"), F.max(ends).alias("y")).filter("x <> y").select("doc")
    owned = known.join(several, "doc", "left_semi").select("doc", "h1", "h2").distinct().join(classes, ["h1", "h2"])
    own = owned.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    forget(often, shared, sets, rare, shared_rare, first, sizes, held, leads, chosen, counts, matrix, sides, members, opened_groups)

    roots = components(links.unionByName(own), "jaccard-components")
    named = materialize(
        classes.join(roots, classes["rep"] == roots["node"], "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id")),
        "jaccard-named",
    )
    forget(links, roots, grouped, classes)
    return signed.select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))).alias("component_id"),
    )
