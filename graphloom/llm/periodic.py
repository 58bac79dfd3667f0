"""Periodic runs of words by Main-Lorentz divide and conquer.

A run is a stretch of words with smallest period q (words q apart are identical), of at
least `least` words and `times` periods, that no neighbouring word extends. The words of
a batch of texts are interned as integers. An interval of words is halved: runs that
cross its middle are found from four Z-functions (of the right half, of the reversed left
half, and of each with the whole behind it), which give for every period q how far words q
apart agree on both sides of the middle; the halves follow in the same way. Intervals of
at most LEAF words, in which periods are short, are compared at each lag at once.

Most texts never get that far. Behind its first period, each word of a run was last seen
at most q words earlier, and that part of the run is at least times - 1 periods long. So
stretches in which some word was last seen further back than their length over times - 1
are cut at this word, again and again until nothing changes; what is left holds all runs.
The same cut is applied to the halves of an interval. It follows from the definition and
loses no run.

Defined results: a null or blank text has no runs and collapses to the empty text; texts
of any length are read whole; equal words are equal bytes (hashes are compared byte by
byte); rows are judged one by one, so repeated rows have repeated results; columns named
like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import TEXT_BYTES, by_bytes, bytes_of, hash_words, raw, split_words

#: Words and periods of a run, as queries use them; words of an interval that is compared lag by lag (`times` is 2 or more).
LEAST, TIMES, LEAF = 6, 4, 128
#: Values of a Z-function that are found for all places at once; lags that a stretch within a run is compared at instead of being halved.
SHORT, LAGS = 8, 64

RESULT = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: binary>"


# --- interned words ---------------------------------------------------------------
def _equal_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether the words i and j are the same bytes, for all of two arrays of words."""
    size = stops[i] - starts[i]
    if (size != stops[j] - starts[j]).any():
        return False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    at = 0
    while len(i):
        m = masks[np.minimum(size - at, 8)]
        if ((eights[starts[i] + at] ^ eights[starts[j] + at]) & m).any():
            return False
        at += 8
        more = size > at
        i, j, size = i[more], j[more], size[more]
    return True


def intern(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words."""
    if not len(starts):
        return np.empty(0, np.int64)
    h = hash_words(data, starts, stops)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    again = np.flatnonzero(~new)
    if not _equal_words(data, starts, stops, order[again], order[again - 1]):
        seen: dict[bytes, int] = {}  # two words of one hash
        return np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), stops.tolist())], np.int64)
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids


def last_seen(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words since the last equal word of the same text; very many where there is none."""
    out = np.full(len(ids), 1 << 40, np.int64)
    if len(ids):
        order = np.argsort(ids, kind="stable")
        text = np.searchsorted(bounds, order, side="right")
        same = (ids[order[1:]] == ids[order[:-1]]) & (text[1:] == text[:-1])
        out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


# --- stretches that can hold a run ------------------------------------------------
def stretches(back: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Intervals that hold every run of a sequence; back: see last_seen (an array may hold several texts)."""
    at = np.arange(len(back))
    while len(at):
        cut = np.flatnonzero(np.diff(at, prepend=-2, append=len(back) + 1) > 1)
        size = np.diff(cut)  # of the stretches of neighbouring places
        far = np.repeat(size // (times - 1), size)
        stay = (back[at] <= far) & np.repeat(size >= least - least // times, size)
        if stay.all():
            low = at[cut[:-1]]
            return list(zip((low - size // (times - 1)).tolist(), (low + size).tolist()))
        at = at[stay]
    return []


# --- Z-functions ------------------------------------------------------------------
def agree(s: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on, i > j, by slices of growing size."""
    n, done, step = len(s) - i, 0, 16
    while done < n:
        k = min(step, n - done)
        differ = s[i + done : i + done + k] != s[j + done : j + done + k]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + k, step * 4
    return n


def z_function(s: np.ndarray) -> np.ndarray:
    """For each place, how many words from there on equal those from the start on.

    Values under SHORT come from comparing all places word by word. Of the others, within
    the stretch known to equal the start, values are copied from the start as one slice,
    up to the first place whose value reaches the stretch's end.
    """
    n = len(s)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    heads, k = np.flatnonzero(s == s[0])[1:], 1
    while len(heads) and k < SHORT:
        z[heads] = k
        heads = heads[heads < n - k]
        heads = heads[s[heads + k] == s[k]]
        k += 1
    z[0], place = n, np.arange(n)
    i, known = (int(heads[0]) if len(heads) else n), 0
    while i < n:
        size = known + (agree(s, i + known, known) if i + known < n else 0)
        z[i] = size
        at, step, stop = 1, 32, size  # the first value that reaches the end, by slices of growing size
        while at < size and stop == size:
            to = min(size, at + step)
            reach = z[at:to] >= size - place[at:to]
            first = int(reach.argmax())
            if reach[first]:
                stop = at + first
            at, step = to, step * 4
        z[i + 1 : i + stop] = z[1:stop]
        i, known = i + max(stop, 1), size - stop
        if known < SHORT:
            k = int(np.searchsorted(heads, i))
            i, known = (int(heads[k]) if k < len(heads) else n), 0
    return z


def crossing(s: np.ndarray, middle: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches that cross the middle, hold `times` periods and end where words differ or s ends."""
    u, v = s[:middle], s[middle:]
    back, end = u[::-1], np.full(1, -1, s.dtype)
    found = []
    # one period or more behind the middle: words q apart from the middle on, and before it
    q = np.arange(1, min(len(v), len(s) // times) + 1)
    ahead = np.append(z_function(v), 0)[q]
    behind = z_function(np.concatenate([back, end, s[::-1]]))[len(u) + 1 + len(v) - q]
    found.append((middle - behind, middle + q + ahead, q))
    # one period or more before the middle
    q = np.arange(1, min(len(u), len(s) // times) + 1)
    ahead = z_function(np.concatenate([v, end, s]))[len(v) + 1 + len(u) - q]
    behind = np.append(z_function(back), 0)[q]
    found.append((middle - q - behind, middle + ahead, q))
    out = []
    for low, high, q in found:
        ok = np.flatnonzero(high - low >= np.maximum(times * q, least))
        out += zip(low[ok].tolist(), high[ok].tolist(), q[ok].tolist())
    return out


def lags(s: np.ndarray, most: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches with periods up to `most`, by comparing the sequence with itself at each lag."""
    out = []
    for q in range(1, min(most, len(s) // times) + 1):
        same = np.concatenate([[False], s[q:] == s[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if high - low + q >= max(times * q, least):
                out.append((low, high + q, q))
    return out


def find_runs(ids: np.ndarray, back: np.ndarray, roots=None, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of integers >= 0, by start and period."""
    n, best = len(ids), {}
    stack = [(max(0, a), min(n, b)) for a, b in (stretches(back, least, times) if roots is None else roots)]
    while stack:
        low, high = stack.pop()
        if high - low < least:
            continue
        s = ids[low:high]
        if high - low <= LEAF:
            rows = lags(s, high - low, least, times)
        else:
            middle, rows = (high - low) // 2, []
            across = crossing(s, middle, least, times)
            for a, b in ((0, middle), (middle, high - low)):
                within = min((q for x, y, q in across if x <= a and b <= y), default=None)
                if within is not None and within // (times - 1) <= LAGS:
                    # two periods can't share as many words as both have: other runs in here have less than within / (times - 1)
                    rows += [(a + x, a + y, q) for x, y, q in lags(s[a:b], (within - 1) // (times - 1), least, times)]
                else:
                    stack += [(low + max(a, a + x), low + a + y) for x, y in stretches(back[low + a : low + b], least, times)]
            rows += across
        for a, b, q in rows:
            a, b = a + low, b + low
            if (a and ids[a - 1] == ids[a - 1 + q]) or (b < n and ids[b] == ids[b - q]):
                continue  # cut off by the interval: found whole where its middle was crossed first
            if q < best.get((a, b), n + 1):
                best[a, b] = q
    return sorted((a, b - a, q) for (a, b), q in best.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


# --- texts ------------------------------------------------------------------------
def _of_texts(part: pa.Array, least: int, times: int):
    """(runs, collapsed text) of each BINARY text of a slice."""
    data, bounds = bytes_of(part)
    starts, stops, ends = split_words(data, bounds)
    ids = intern(data, starts, stops)
    back = last_seen(ids, ends[1:-1])
    roots: dict[int, list] = {}
    for a, b in stretches(back, least, times):  # a stretch ends with its text, as first words were never seen
        k = int(np.searchsorted(ends, b - 1, side="right")) - 1
        roots.setdefault(k, []).append((a - int(ends[k]), b - int(ends[k])))
    for k, text in enumerate(part):
        words = text.as_py().split()
        if k not in roots:
            yield [], b" ".join(words)
            continue
        a, b = int(ends[k]), int(ends[k + 1])
        runs = find_runs(ids[a:b], back[a:b], roots[k], least, times)
        if runs:
            words = [words[i] for i in np.flatnonzero(~dropped(b - a, runs)).tolist()]
        yield runs, b" ".join(words)


def find(text: Column | str, least: int = LEAST, times: int = TIMES) -> Column:
    """Struct of `runs` (start, length, period in words, by start and period) and `collapsed`, the text without repeated periods."""

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        runs, collapsed = [], []
        for part in by_bytes(texts, TEXT_BYTES):
            for r, c in _of_texts(part, least, times):
                runs.append(r)
                collapsed.append(c)
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(collapsed, pa.binary())], names=["runs", "collapsed"])

    return of(raw(text))


def runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with `runs`, the text `collapsed` without repeated periods, and `strongest`, the run of the most periods (null: no run)."""
    out = docs.withColumn("__p", find(text, least, times)).withColumns({"runs": F.col("__p.runs"), "collapsed": F.col("__p.collapsed").cast("string")})
    # exact order of fractions: length1 * period2 against length2 * period1; then start, then period
    first = F.expr(
        "array_sort(runs, (a, b) -> case when a.length * b.period > b.length * a.period then -1 when a.length * b.period < b.length * a.period then 1"
        " when a.start < b.start then -1 when a.start > b.start then 1 when a.period < b.period then -1 when a.period > b.period then 1 else 0 end)"
    )
    return out.withColumn("strongest", F.get(first, F.lit(0))).drop("__p")
