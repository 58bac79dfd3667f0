"""Names of a table found in texts by Aho-Corasick automata: one pass over each text finds all names.

Up to AT_ONCE names are one automaton that every task gets. Of more, every task gets only
the first characters that names have and the lengths that go with them: from each free
place of a text, stretches that begin and measure like a name and end free are looked up
among the names by an equi-join. Names that all begin alike are no harder than others.

A name counts where no letter, digit or underscore stands next to it, as it is written
(upper and lower case differ). Where names overlap, the one that begins first counts, and
of these the longest.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.plugins import Provider
from graphloom.sources.store import stored

#: Names of an automaton; first characters that tell where a name may begin.
AT_ONCE, HEAD = 200_000, 3
FOUND = "array<struct<label: string, name: string, start: int>>"
_ROW = pa.list_(pa.struct([("label", pa.string()), ("name", pa.string()), ("start", pa.int32())]))


def automaton(names: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """Of (label, name); of one name under several labels the first by the alphabet counts."""
    out = ahocorasick.Automaton()
    for label, name in sorted(names, reverse=True):
        out.add_word(name, (label, name))
    out.make_automaton()
    return out


def _inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def _hits(a: ahocorasick.Automaton, text: str | None):
    """(label, name, start) of all names with free ends in a text, overlapping or not."""
    if not text or not len(a):
        return
    for last, (label, name) in a.iter(text):
        start = last + 1 - len(name)
        if not (start and _inner(text[start - 1])) and not (last + 1 < len(text) and _inner(text[last + 1])):
            yield label, name, start


def _settled(hits) -> list[tuple[str, str, int]]:
    """Those that count, in order."""
    out, free = [], 0
    for start, size, label, name in sorted((s, -len(n), x, n) for x, n, s in hits):
        if start >= free:
            out.append((label, name, start))
            free = start - size
    return out


def places(a: ahocorasick.Automaton, text: str | None) -> list[tuple[str, str, int]]:
    """(label, name, start) in a text, in order."""
    return _settled(_hits(a, text))


def _pieces(rows) -> pa.Array:
    return pa.array([[{"label": x, "name": n, "start": s} for x, n, s in row] for row in rows], _ROW)


def tag(docs: DataFrame, names: DataFrame, key: str, text: str, at_once: int = AT_ONCE) -> DataFrame:
    """key, found: the names (label, name) in each text, with their places in characters; rows of one key are one document each."""
    known = names.select("label", "name").filter("name <> ''").distinct()
    n = known.count()
    if n <= at_once:
        a = automaton([(r["label"], r["name"]) for r in known.collect()])  # bounded by at_once

        @F.arrow_udf(FOUND)
        def found(texts: pa.Array) -> pa.Array:
            return _pieces(places(a, t.as_py()) for t in texts)

        return docs.select(key, found(F.col(text)).alias("found"))
    return _joined(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), known).withColumnRenamed("key", key)


def _stretches(shapes: dict[str, list[int]], text: str | None):
    """(start, stretch): what begins like a name, is as long as one that begins so, and has free ends."""
    text = text or ""
    heads = sorted({len(h) for h in shapes})
    for start in range(len(text)):
        if start and _inner(text[start - 1]):
            continue
        for n in heads:
            for size in shapes.get(text[start : start + n], ()):
                stop = start + size
                if stop <= len(text) and not (stop < len(text) and _inner(text[stop])):
                    yield start, text[start:stop]


def _joined(docs: DataFrame, names: DataFrame) -> DataFrame:
    kind = docs.schema["key"].dataType.simpleString()
    one = names.groupBy("name").agg(F.min("label").alias("label"))
    shapes: dict[str, list[int]] = {}
    for head, size in one.select(F.left("name", F.lit(HEAD)), F.length("name")).distinct().collect():  # a few beginnings and lengths, not names
        shapes.setdefault(head, []).append(size)

    @F.arrow_udf("array<struct<start: int, name: string>>")
    def met(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "name": x} for s, x in _stretches(shapes, t.as_py())] for t in texts], pa.list_(pa.struct([("start", pa.int32()), ("name", pa.string())])))

    rows = stored(docs.select(F.col("key").cast(kind).alias("key"), met("text").alias("met")).withColumn("row", F.monotonically_increasing_id()), "names-met")
    hits = rows.select("row", F.inline("met")).join(one, "name")

    @F.arrow_udf(FOUND)
    def settle(found: pa.Array) -> pa.Array:
        return _pieces(_settled([(h["label"], h["name"], h["start"]) for h in row or []]) for row in found.to_pylist())

    listed = hits.groupBy("row").agg(F.collect_list(F.struct("label", "name", "start")).alias("hits"))
    return rows.join(listed, "row", "left").select("key", settle(F.coalesce("hits", F.expr(f"cast(array() as {FOUND})"))).alias("found"))


class NameTagger(Provider):
    """The same as a provider for texts: lines of label, tab and name."""

    name = "names"

    def __init__(self, names: list[tuple[str, str]]):
        self.automaton = automaton(names)

    def answer(self, texts: list[str]) -> list[str]:
        return ["\n".join(f"{label}\t{name}" for label, name, _ in places(self.automaton, t)) for t in texts]


def brute(names: list[tuple[str, str]], text: str | None) -> list[tuple[str, str, int]]:
    """The definition, name by name: for tests."""
    hits = []
    for name in {n for _, n in names}:
        label = min(x for x, n in names if n == name)
        hits += [(label, name, m.start()) for m in re.finditer(f"(?={re.escape(name)})", text or "")]
    t = text or ""
    return _settled([h for h in hits if not (h[2] and _inner(t[h[2] - 1])) and not (h[2] + len(h[1]) < len(t) and _inner(t[h[2] + len(h[1])]))])
