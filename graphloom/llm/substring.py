"""Substring dedup: passages that an earlier document has, by banded paragraphs and by windows of words.

Rows are told apart by their id and a hash of their text: rows that agree in both are one
document. Documents come in the order of their ids (nulls last), then of these hashes;
of what repeats, the first stays. Words are lower-cased and split at ASCII white space.

Paragraphs. A line of MIN_WORDS or more words is a paragraph; shorter lines in a row,
up to a blank or a longer one, are one together if they have as many words.

1. Equal paragraphs are one class, by a 64-bit hash of their words.
2. Each has a MinHash signature of its 5-word shingles in BANDS bands of ROWS rows: at a
   Jaccard similarity of 0.8 two collide with a probability of 1 - (1 - 0.8**3)**9 = 0.998.
3. In buckets of two or three classes all pairs are compared. The classes of larger
   buckets go through the exact join of op5, so that no pair that collides is left out.
4. A pair stays if the exact Jaccard similarity of the shingle sets is 0.8 or more.
5. Components of the links: the paragraph that comes first is kept, the others go.

Windows. A passage may begin and end anywhere, and its lines may break anywhere. Every
window of `run` words goes by the least hash of SEED words in it (a MinHash of one row);
windows in a row that go by the same place are one unit, about one for 16 words.

1. Units that share their least hash with no other document are dropped.
2. The others are held, word by word, against the first unit with that hash. All windows
   inside the stretch that agrees repeat the first one's.
3. What windows of a unit are left over are grouped by their own hashes, whose first is
   kept. So every window that occurs before is found, whoever has it.
4. Windows that follow each other in both documents become one passage.

Places that repeat at a short period within a document (one word over and over) are one
unit with the length of the repetition, so that they don't multiply.

Words are compared by 16-bit fingerprints here; hashes of windows and paragraphs are of
64 bits. With `within`, repeats inside one document count too; a copy that overlaps its
own first keeps `run` words of it. remove() takes out whatever repeats; documents of which
nothing is left go.

Defined results: null and blank texts have no passages; rows with one id and different
texts are different documents; a null id is an id like any other and comes last; very
long lines and texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import jaccard
from graphloom.llm.common import (
    LOWER,
    TEXT_BYTES,
    U64,
    binary_of,
    by_bytes,
    bytes_of,
    components,
    forget,
    hash_words,
    keep_held,
    materialize,
    may_hold,
    mix64,
    passes,
    raw,
    shuffle_partitions,
    slices,
    split_words,
    wide_filter,
)

#: Least words of a paragraph; words and similarity of its shingles; its MinHash bands.
MIN_WORDS, SHINGLE, PER_CENT = 20, 5, 80
BANDS, ROWS = 9, 3
#: Words of a window, and of the seeds that windows go by.
RUN, SEED = 50, 20
#: Documents whose units are looked at together.
AT_ONCE = 128
#: Low bits of a seed's rank, which hold its place: of equal seeds the leftmost is the least.
PLACE = U64((1 << 26) - 1)
FACTOR = 0x9E3779B97F4A7C15
NULL_ID = (1 << 63) - 1
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1).astype(U64)) | U64(1)


# --- hashes of runs of words ------------------------------------------------------
@functools.lru_cache(1)
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(FACTOR, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size, f, U64)])) for f in (FACTOR, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse, n + 1 or more of each."""
    return _power_tables(1 << max(16, n.bit_length()))


class Runs:
    """Hashes of any runs of an array of hashed words, which depend on nothing around them."""

    def __init__(self, words: np.ndarray):
        power, self.back = powers(len(words))
        self.sums = np.concatenate([[U64(0)], np.cumsum(words * power[: len(words)])])

    def all(self, size: int) -> np.ndarray:
        """Of all runs of `size` words."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.back[:n] + U64(size)) if n > 0 else np.empty(0, U64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the runs [start, stop)."""
        return mix64((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(U64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def units(runs: Runs, doc_of: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """(place of the seed, its hash, first window, last window, length of repetition) of each unit of texts in a row."""
    n = len(doc_of)
    if n < run:
        return tuple(np.empty(0, np.int64 if k != 1 else U64) for k in range(5))
    seeds = runs.all(SEED)
    rank = (seeds & ~PLACE) | (np.arange(len(seeds)).astype(U64) & PLACE)
    least = sliding_least(rank, run - SEED + 1)
    window = np.flatnonzero(doc_of[: n - run + 1] == doc_of[run - 1 :])
    place = window + ((least[window] - window.astype(U64)) & PLACE).astype(np.int64)
    if not len(window):
        return units(runs, doc_of[:0], run)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
    at, low, high = place[new], window[new], window[np.append(new[1:], len(window)) - 1]
    mark = seeds[at]
    # neighbours that see the same words all around, one period apart
    step = np.diff(at, prepend=-n)
    same = np.flatnonzero((mark[1:] == mark[:-1]) & (low[1:] - low[:-1] == step[1:]) & (high[1:] - high[:-1] == step[1:]) & (step[1:] <= run - SEED)) + 1
    first, last = at[same - 1] - (run - SEED), at[same] + run
    inside = (first >= 0) & (last <= n)
    same, first, last = same[inside], first[inside], last[inside]
    inside = doc_of[first] == doc_of[last - 1]
    same, first, last = same[inside], first[inside], last[inside]
    length = 2 * run - SEED
    same = same[runs.of(first, first + length) == runs.of(last - length, last)]
    follows = np.zeros(len(at), bool)
    follows[same] = True
    follows[1:] &= ~(follows[:-1] & (step[1:] != step[:-1]))
    head = np.flatnonzero(~follows)
    tail = np.append(head[1:], len(at)) - 1
    return at[head], mark[head], low[head], high[head], at[tail] - at[head]


def band_hashes(shingles: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """MinHash band hashes (a row per span) of spans [from, to) of an array of shingle hashes, none of them empty."""
    if not len(spans):
        return np.empty((0, BANDS), np.int64)
    at = spans.ravel()
    padded = np.append(shingles, U64(0xFFFFFFFFFFFFFFFF))
    least = np.stack([np.minimum.reduceat((padded ^ s) * s, at)[::2] for s in SEEDS], 1)
    bands = mix64(least).reshape(len(spans), BANDS, ROWS)
    salt = mix64(np.arange(BANDS * ROWS).astype(U64)).reshape(BANDS, ROWS)
    return mix64((bands * (salt | U64(1))).sum(2, dtype=U64) + salt[:, 0]).view(np.int64)


# --- sketches of documents ----------------------------------------------------------
def paragraphs(sizes: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """(first word, number of words, document) of the paragraphs of lines in a row, given their words and documents."""
    short = (sizes > 0) & (sizes < MIN_WORDS)
    new = np.ones(len(sizes), bool)  # short lines in a row of one document go together
    new[1:] = ~(short[1:] & short[:-1] & (doc_of[1:] == doc_of[:-1]))
    head = np.flatnonzero(new)
    words = np.add.reduceat(sizes, head) if len(head) else sizes
    first = np.cumsum(words) - words
    own = words >= MIN_WORDS
    return np.stack([first[own], words[own], doc_of[head][own]], 1)


SKETCH = (
    "d long, k long, n int, prints binary, marks array<long>, places binary, "
    "first array<int>, size array<int>, h array<long>, bands array<array<long>>"
)


def _sketcher(run: int):
    def sketch(part):
        data, bounds = bytes_of(part.column(2))
        starts, stops, ends = split_words(data, bounds)
        hashed = hash_words(LOWER.take(data), starts, stops)
        docs, sizes = len(ends) - 1, np.diff(ends)
        runs, doc_of = Runs(hashed), np.repeat(np.arange(docs), sizes)
        lines = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
        lines = lines[lines < len(data)]
        line_words = np.diff(np.append(np.searchsorted(starts, lines), len(starts)))
        found = paragraphs(line_words, np.searchsorted(bounds, lines, side="right") - 1)
        spans, owners = found[:, :2], found[:, 2]
        at, mark, low, high, more = units(runs, doc_of, run)
        owner = doc_of[low]
        base = ends[owner]
        places = np.stack([at - base, low - base, high - base, more], 1).astype("<i4")
        unit_ends = np.searchsorted(owner, np.arange(docs + 1))
        span_ends = np.searchsorted(owners, np.arange(docs + 1)).astype(np.int32)
        bands = band_hashes(runs.all(SHINGLE), np.stack([spans[:, 0], spans.sum(1) - SHINGLE + 1], 1))
        h = runs.of(spans[:, 0], spans.sum(1)).view(np.int64)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(span_ends), x)
        by_span = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        columns = [
            part.column(0), part.column(1), pa.array(sizes.astype(np.int32)),
            binary_of((hashed >> U64(48)).astype("<u2"), ends * 2),
            pa.ListArray.from_arrays(pa.array(unit_ends.astype(np.int32)), pa.array(mark.view(np.int64))),
            binary_of(places, unit_ends * 16),
            lists(pa.array((spans[:, 0] - ends[owners]).astype(np.int32))), lists(pa.array(spans[:, 1].astype(np.int32))), lists(pa.array(h)), lists(by_span),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_names(SKETCH))

    def run_all(batches):
        for batch in batches:
            at = 0
            for texts in by_bytes(batch.column(2), TEXT_BYTES):
                yield sketch(batch.slice(at, len(texts)))
                at += len(texts)

    return run_all


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, k, text): id, a null as the largest number; hash of the text, odd for a null id; its bytes."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("d"), _text_hash(key, text).alias("k"), raw(text).alias("text"))


def _text_hash(key: str, text: str) -> Column:
    """63 bits of the text's hash, and a bit that tells a null id from the largest one."""
    return F.xxhash64(raw(text)).bitwiseAND(F.lit(-2).cast("long")) + F.col(key).isNull().cast("long")


def _id(d: str, k: str) -> Column:
    """The id of a row (d, k)."""
    return F.when((F.col(d) != NULL_ID) | (F.col(k).bitwiseAND(F.lit(1).cast("long")) == 0), F.col(d))


def sketches(docs: DataFrame, key: str, text: str, run: int) -> DataFrame:
    return materialize(keyed(docs, key, text).mapInArrow(_sketcher(run), SKETCH), "substring-sketches")


# --- windows --------------------------------------------------------------------
OCCURRENCE = "m long, d long, k long, at int, low int, high int, more int, n int, around binary"


def _occurrences(table: np.ndarray, run: int, within: bool):
    """The units of sketches (d, k, n, prints, marks, places) whose marks the filter holds, with the words around."""
    before, length = run - SEED, 2 * run - SEED

    def run_all(batches):
        for batch in batches:
            for part in slices(batch, AT_ONCE):
                marks = part.column(4)
                counts = np.diff(np.asarray(marks.offsets))
                flat = marks.flatten().to_numpy(zero_copy_only=False)
                if not len(flat):
                    continue
                places = np.frombuffer(b"".join(part.column(5).to_pylist()), "<i4").reshape(-1, 4)
                own = np.flatnonzero(passes(table, flat) | (places[:, 3] > 0) & within)
                if not len(own):
                    continue
                prints = part.column(3).to_pylist()
                sizes = np.fromiter(map(len, prints), np.int64, len(prints)) // 2
                words = np.frombuffer(b"\0" * (2 * before) + b"".join(prints) + b"\0" * (2 * run), "<u2")
                starts = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(counts)), counts)[own]
                at = places[own]
                view = np.lib.stride_tricks.sliding_window_view(words, length)
                around = view[starts[doc] + at[:, 0]]  # starts `before` words ahead of the seed
                columns = [pa.array(flat[own]), part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc))]
                columns += [pa.array(np.ascontiguousarray(at[:, c])) for c in range(4)]
                columns += [pa.array(sizes[doc].astype(np.int32)), binary_of(around, np.arange(len(own) + 1) * 2 * length)]
                yield pa.RecordBatch.from_arrays(columns, names=_names(OCCURRENCE))

    return run_all


COMPARED = "d long, k long, start int, stop int, low int, high int, more int, fd long, fk long, fstart int, windows array<long>, starts array<int>"


def _leading(equal: np.ndarray) -> np.ndarray:
    """How many columns are true from the first on, per row."""
    return np.where(equal.all(1), equal.shape[1], equal.argmin(1))


def _compare(run: int):
    """Units beside the first one with their mark: the stretch that agrees, if it is long enough, and the windows that it doesn't hold.

    Columns: OCCURRENCE without the mark, then fd, fk, fat, fn and faround.
    """
    before, length = run - SEED, 2 * run - SEED

    def run_all(batches):
        power, back = (x[: length + 1] for x in powers(length))
        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11)]
            d, k, at, low, high, more, n, fd, fk, fat, fn = c
            if not len(d):
                continue
            mine, its = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(-1, length) for x in (7, 12))
            equal = mine == its
            left = np.minimum(_leading(equal[:, before - 1 :: -1]), np.minimum(at, fat))
            right = np.minimum(_leading(equal[:, before + SEED :]), np.minimum(n - at, fn - fat) - SEED)
            start, stop = at - left, at + SEED + right
            whole = stop - start >= run
            # windows that aren't inside: [low, one) and [two, high]
            one, two = np.where(whole, np.clip(start, low, high + 1), high + 1), np.where(whole, np.clip(stop - run + 1, low, high + 1), high + 1)
            sizes = (one - low) + (high + 1 - two)
            rest = np.flatnonzero(sizes)
            row = np.repeat(rest, sizes[rest])
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[rest]) - sizes[rest], sizes[rest])
            first = low[row] + place
            first = np.where(first < one[row], first, first + (two - one)[row])
            sums = np.zeros((len(rest), length + 1), U64)
            np.cumsum(mix64(mine[rest].astype(U64) + U64(1)) * power[:length], 1, out=sums[:, 1:])
            offset, line = first - at[row] + before, np.repeat(np.arange(len(rest)), sizes[rest])
            windows = mix64((sums[line, offset + run] - sums[line, offset]) * back[offset])
            itself = (d == fd) & (k == fk) & (at == fat)
            keep = (whole & ~itself) | (more > 0) | (sizes > 0)
            found = whole & ~itself
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32))
            columns = [pa.array(d[keep]), pa.array(k[keep])]
            empty = ~found[keep]
            columns += [pa.array(x[keep].astype(np.int32), mask=empty) for x in (start, stop)]
            columns += [pa.array(x[keep].astype(np.int32)) for x in (low, high, more)]
            columns += [pa.array(fd[keep]), pa.array(fk[keep]), pa.array((fat - left)[keep].astype(np.int32), mask=empty)]
            columns += [pa.ListArray.from_arrays(ends, pa.array(windows.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(first.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=_names(COMPARED))

    return run_all


PIECE = "d long, k long, fd long, fk long, away int, start int, stop int, fstop int"


def _pieces(batches):
    """Rows of PIECE that overlap or meet, joined; they come by d, k, fd, fk, away, start."""
    held = None
    for batch in batches:
        c = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(8)]
        if held is not None:
            c = [np.concatenate([h, x]) for h, x in zip(held, c)]
        if not len(c[0]):
            continue
        head = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in c[:5]], axis=0)]))
        group = np.zeros(len(c[0]), np.int64)
        group[head] = 1
        # a group's rows are lifted above those of the groups before it: one running maximum serves them all
        lift = (np.cumsum(group) - 1) << 32
        reach = np.maximum.accumulate(c[6] + lift)
        new = np.concatenate([[True], (c[5][1:] + lift[1:] > reach[:-1])])
        first = np.flatnonzero(new)
        c = [np.maximum.reduceat(x, first) if k > 5 else x[first] for k, x in enumerate(c)]
        held = [x[-1:] for x in c]
        yield _as_pieces([x[:-1] for x in c])
    if held is not None:
        yield _as_pieces(held)


def _as_pieces(columns):
    fields = [f.split() for f in PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.int32()) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _join_pieces(rows: DataFrame) -> DataFrame:
    fields = _names(PIECE)
    dealt = rows.select(*fields).repartition(shuffle_partitions(rows.sparkSession), "d", "k")
    return dealt.sortWithinPartitions(*fields[:6]).mapInArrow(_pieces, PIECE)


def _elsewhere(within: bool) -> Column:
    """Whether rows of `first` and `last` (d, k, ...) are of two documents, or count within one."""
    return (F.col("n") > 1) if within else (F.col("first.d") != F.col("last.d")) | (F.col("first.k") != F.col("last.k"))


FOUND = ["d", "k", "start", "stop", "fd", "fk", "fstart", "removed"]


def repeated_windows(sketched: DataFrame, run: int, within: bool) -> DataFrame:
    """Passages of `run` words or more that an earlier document has, and the first of each: FOUND, in words."""
    marks = sketched.select(F.xxhash64("d", "k").alias("doc"), F.explode("marks").alias("m")).groupBy("m")
    often = marks.agg(F.count("*").alias("n")).filter("n > 1") if within else marks.agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x <> y")
    often = materialize(often.select("m"), "substring-marks")
    table = wide_filter(often, "m")
    forget(often)
    held = sketched.select("d", "k", "n", "prints", "marks", "places").mapInArrow(_occurrences(table, run, within), OCCURRENCE)
    held = materialize(held, "substring-units")
    first, last = F.min(F.struct("d", "k", "at", "n", "around")).alias("first"), F.max(F.struct("d", "k")).alias("last")
    firsts = held.groupBy("m").agg(first, last, F.count("*").alias("n"), F.max("more").alias("most"))
    firsts = firsts.filter(_elsewhere(within) | (F.col("most") > 0) & F.lit(within))
    firsts = materialize(firsts.select("m", *[F.col(f"first.{c}").alias(f"f{c}") for c in ("d", "k", "at", "n", "around")]), "substring-firsts")
    beside = held.join(firsts, "m").select("d", "k", "at", "low", "high", "more", "n", "around", "fd", "fk", "fat", "fn", "faround")
    compared = materialize(beside.mapInArrow(_compare(run), COMPARED), "substring-compared")
    forget(held, firsts)

    left = compared.select("d", "k", "more", F.explode(F.arrays_zip("windows", "starts")).alias("w")).select("d", "k", "more", "w.*")
    left = materialize(left.withColumnsRenamed({"windows": "w", "starts": "at"}), "substring-windows")
    first, last = F.min(F.struct("d", "k", "at")).alias("first"), F.max(F.struct("d", "k")).alias("last")
    known = materialize(left.groupBy("w").agg(first, last, F.count("*").alias("n")).filter(_elsewhere(within)).select("w", "first.*"), "substring-known")
    known = known.withColumnsRenamed({"d": "fd", "k": "fk", "at": "fstart"})
    alone = left.join(known, "w").select("d", "k", F.col("at").alias("start"), (F.col("at") + run).alias("stop"), "more", "fd", "fk", "fstart")
    rows = compared.filter("start is not null").select(alone.columns).unionByName(alone)
    same = (F.col("d") == F.col("fd")) & (F.col("k") == F.col("fk"))
    if within:
        # what is repeated at once: its first window stays
        own = compared.filter("more > 0").select("d", "k", F.col("low").alias("start"), (F.col("high") + run).alias("stop"), "more", F.col("d").alias("fd"), F.col("k").alias("fk"), F.col("low").alias("fstart"))
        rows = rows.filter(~same | (F.col("start") != F.col("fstart"))).unionByName(own)
        start = F.when(same, F.greatest("start", F.col("fstart") + run)).otherwise(F.col("start"))
    else:
        rows, start = rows.filter(~same), F.col("start")
    rows = rows.select(
        "d", "k", "fd", "fk", (F.col("start") - F.col("fstart")).alias("away"), start.alias("start"),
        (F.col("stop") + F.col("more")).alias("stop"), (F.col("fstart") + F.col("stop") - F.col("start")).alias("fstop"),
    ).filter("start < stop")
    pieces = materialize(_join_pieces(rows), "substring-pieces")
    kept = pieces.select("fd", "fk", (F.col("start") - F.col("away")).alias("start"), F.col("fstop").alias("stop")).distinct()
    kept = kept.select(F.col("fd").alias("d"), F.col("fk").alias("k"), "fd", "fk", F.lit(0).alias("away"), "start", "stop", F.col("stop").alias("fstop"))
    kept = materialize(_join_pieces(kept), "substring-kept")
    forget(compared, left, known)
    both = pieces.withColumn("removed", F.lit(True)).unionByName(kept.withColumn("removed", F.lit(False)))
    return both.withColumn("fstart", F.col("start") - F.col("away")).select(FOUND)


# --- paragraphs -------------------------------------------------------------------
def similar(a: bytes, b: bytes) -> bool:
    """Exact Jaccard similarity of the shingle sets of two paragraphs, given as 16-bit prints of their words."""
    x, y = (np.unique(Runs(mix64(np.frombuffer(t, "<u2").astype(U64) + U64(1))).all(SHINGLE)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PER_CENT * (len(x) + len(y) - both)


def alike(a: str, b: str) -> Column:
    """similar() of two columns."""

    @F.arrow_udf("boolean")
    def pairs_alike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([similar(p.as_py(), q.as_py()) for p, q in zip(x, y)], pa.bool_())

    return pairs_alike(a, b)


def _bands(sketched: DataFrame) -> DataFrame:
    """(h, bucket) of the classes of paragraphs in buckets that two of them share at least, with the number and ends of each bucket's."""
    banded = sketched.select(F.explode(F.arrays_zip("h", "bands")).alias("p")).select("p.h", F.explode("p.bands").alias("bucket"))
    ends = banded.groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high")
    ends = materialize(ends, "paragraph-buckets")
    some = sketched.select(F.explode(F.arrays_zip("h", "bands")).alias("p")).select("p.h", F.explode(keep_held(ends, "bucket", "p.bands")).alias("bucket"))
    shared = materialize(some.distinct().join(ends, "bucket"), "paragraph-bands")
    sizes = materialize(shared.groupBy("bucket").agg(F.count("*").alias("n")), "paragraph-crowds")
    out = materialize(shared.join(sizes, "bucket").select("h", "low", "high", "n"), "paragraph-shared")
    forget(ends, shared, sizes)
    return out


def repeated_paragraphs(sketched: DataFrame, run: int, within: bool) -> DataFrame:
    """Paragraphs that an earlier document has or nearly has, and the first of each kind: FOUND, in words.

    Equal ones of `run` words or more are left to repeated_windows().
    """
    shared = _bands(sketched)
    leaders = F.explode(F.array("low", "high")).alias("leader")
    pairs = shared.filter("n <= 3").select("h", leaders).filter("h <> leader")
    pairs = materialize(pairs.select(F.least("h", "leader").alias("a"), F.greatest("h", "leader").alias("b")).distinct(), "paragraph-pairs")
    crowd = materialize(shared.filter("n > 3").select("h").distinct(), "paragraph-crowd")
    forget(shared)
    asked = materialize(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).unionByName(crowd).distinct(), "paragraph-asked")

    # the words of the paragraphs in question, as prints
    each = sketched.select("prints", F.explode(F.arrays_zip("h", "first", "size")).alias("p")).filter(may_hold(asked, "h", "p.h"))
    words = each.select("p.h", F.substring("prints", 2 * F.col("p.first") + 1, 2 * F.col("p.size")).alias("words"))
    words = materialize(words.join(asked, "h", "left_semi").dropDuplicates(["h"]), "paragraph-words")
    both = pairs.join(words.select(F.col("h").alias("a"), F.col("words").alias("x")), "a")
    both = both.join(words.select(F.col("h").alias("b"), F.col("words").alias("y")), "b")
    spelled = words.join(crowd, "h", "left_semi").select("h", F.regexp_replace(F.hex("words"), "(....)", "$1 ").alias("words"))
    exact = jaccard.join(spelled, "h", "words", SHINGLE, PER_CENT).filter("doc_id <> component_id")
    links = both.filter(alike("x", "y")).select("a", "b").unionByName(exact.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    links = materialize(links, "paragraph-links")
    forget(words, pairs, crowd, asked)
    tops = components(links, "paragraph-components")

    every = sketched.select("d", "k", F.explode(F.arrays_zip("h", "first", "size")).alias("p")).select("d", "k", "p.*")
    first, last = F.min(F.struct("d", "k", "first", "h")).alias("first"), F.max(F.struct("d", "k")).alias("last")
    classes = every.groupBy("h").agg(first, last, F.count("*").alias("n"))
    groups = classes.join(tops, F.col("h") == F.col("node"), "left").select("h", "first", "last", "n", F.coalesce("root", "h").alias("root"))
    groups = materialize(groups, "paragraph-groups")
    sizes = groups.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
    sizes = materialize(sizes.filter(_elsewhere(within)).select("root", "kinds", F.col("first").alias("kept")), "paragraph-sizes")
    named = materialize(groups.select("h", "root").join(sizes, "root").select("h", "kinds", "kept"), "paragraph-named")
    forget(links, tops, groups, sizes)
    found = every.filter(may_hold(named, "h", "h")).join(named, "h")
    itself = (F.col("d") == F.col("kept.d")) & (F.col("k") == F.col("kept.k"))
    removed = ~itself if not within else ~itself | (F.col("first") != F.col("kept.first"))
    found = found.filter((F.col("size") < run) | (F.col("h") != F.col("kept.h")) | ~removed & (F.col("kinds") > 1))
    found = found.select(
        "d", "k", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"), F.col("kept.d").alias("fd"),
        F.col("kept.k").alias("fk"), F.col("kept.first").alias("fstart"), removed.alias("removed"),
    )
    found = materialize(found, "paragraph-repeats")
    forget(named)
    return found


# --- results ----------------------------------------------------------------------
def find(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, within: bool = True) -> DataFrame:
    """Passages and paragraphs that repeat an earlier one, and the first of each kind.

    doc_id, text_hash, first_word, n_words, group_doc_id, group_text_hash, group_first_word
    (the place that is kept), removed.
    """
    if run < SEED + 2:
        raise ValueError(f"passages have {SEED + 2} words at least")
    sketched = sketches(docs, key, text, run)
    both = repeated_windows(sketched, run, within).unionByName(repeated_paragraphs(sketched, run, within))
    forget(sketched)
    return both.select(
        _id("d", "k").alias("doc_id"), F.col("k").alias("text_hash"), F.col("start").alias("first_word"), (F.col("stop") - F.col("start")).alias("n_words"),
        _id("fd", "fk").alias("group_doc_id"), F.col("fk").alias("group_text_hash"), F.col("fstart").alias("group_first_word"), "removed",
    )


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, in characters, and the lines they are in."""
    data = np.frombuffer(text, np.uint8)
    blank = (data == 32) | (data >= 9) & (data <= 13)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, stops = edges[::2], edges[1::2]
    lines = np.searchsorted(np.flatnonzero(data == 10), starts)
    if not text.isascii():
        inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
        starts, stops = starts - inner[starts], stops - inner[stops]
    return starts, stops, lines


def _with_text(docs: DataFrame, spans: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(docs with d and k, one row of spans for each document that has some): `s` holds the spans."""
    spans = spans.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__d"), F.col("text_hash").alias("__k"))
    spans = materialize(spans.agg(F.collect_list(F.struct("first_word", "n_words", "group_doc_id", "group_text_hash", "group_first_word", "removed")).alias("__s")), "substring-spans")
    named = docs.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), "__hash": _text_hash(key, text)})
    return named, spans


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, within: bool = True) -> DataFrame:
    """find(), with the places of the passages in the texts: line, start and length (in characters)."""
    found = materialize(find(docs, key, text, run, within), "substring-found")
    named, spans = _with_text(docs.select(F.col(key), F.col(text)), found, key, text)
    forget(found)

    @F.arrow_udf("array<struct<line: int, start: int, length: int>>")
    def places(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, spans):
            starts, stops, lines = word_places(t.as_py())
            own = [(x["first_word"], x["first_word"] + x["n_words"] - 1) for x in s.as_py()]
            out.append([{"line": int(lines[a]), "start": int(starts[a]), "length": int(stops[b] - starts[a])} for a, b in own])
        return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])))

    rows = named.filter(may_hold(spans, "__k", "__hash")).select(F.col("__id").alias("__d"), F.col("__hash").alias("__k"), raw(text).alias("t")).join(spans.hint("merge"), ["__d", "__k"])
    rows = rows.dropDuplicates(["__d", "__k"]).select("__d", "__k", F.explode(F.arrays_zip(places("t", "__s").alias("p"), F.col("__s").alias("s"))).alias("x"))
    return rows.select(
        _id("__d", "__k").alias("doc_id"), F.col("__k").alias("text_hash"), "x.p.line", "x.p.start", "x.p.length", "x.s.*"
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without spans of characters, and without the line ends of what goes from the start of a line."""
    kept, at, begun = [], 0, 0
    for start, stop in sorted(spans):
        if start > at:
            kept.append(text[at:start])
            begun = start
        at = max(at, stop + (text[stop : stop + 1] == "\n" and text[begun - 1 : begun] in ("", "\n")))
    head, tail = "".join(kept), text[at:]
    return head + tail if tail else head.removesuffix("\n")


def remove(docs: DataFrame, repeats: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the removed passages of find() or duplicates(); documents of which nothing is left go."""
    named, spans = _with_text(docs, repeats.filter("removed"), key, text)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, spans):
            shown = t.as_py()
            if shown is not None and s.is_valid:
                starts, stops, _ = word_places(shown.encode())
                shown = without(shown, [(int(starts[x["first_word"]]), int(stops[x["first_word"] + x["n_words"] - 1])) for x in s.as_py()])
            out.append(shown)
        return pa.array(out, pa.string())

    asked = may_hold(spans, "__k", "__hash")
    rest = named.filter(~asked).select(docs.columns)
    joined = named.filter(asked).join(spans.hint("merge"), (F.col("__id") == F.col("__d")) & (F.col("__hash") == F.col("__k")), "left")
    cleared = joined.withColumn("__text", F.when(F.col("__s").isNotNull(), cut(text, "__s")).otherwise(F.col(text)))
    left = cleared.filter(F.col("__s").isNull() | (F.length(F.trim("__text")) > 0))
    return left.select(*[F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]).unionByName(rest)
