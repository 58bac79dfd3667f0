"""Chunkers and repairs that need match positions or recursion: Arrow functions over whole texts."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", ", ", " ", "")
HEADINGS = (r"\n\s*#+\s*[A-Z][^#\n]*", r"\n\s*[A-Z][A-Z\s]{10,}:?\s*\n", r"\n\s*\d+\.\s*[A-Z]")  # fixed values


def tokens(text: str) -> int:
    return len(text) // 4


def recursive(text: str, size: int = 500, overlap: int = 50, separators=SEPARATORS) -> list[str]:
    """Split at the coarsest separator that occurs, again inside pieces that are too long, and join up to `size` with an overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s and s in text), len(separators) - 1)
    sep = separators[at]
    parts = list(text) if not sep else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out, held, length = [], [], 0

    def close():
        nonlocal held, length
        joined = "".join(held).strip()
        if joined:
            out.append(joined)
        while held and (length > overlap):
            length -= len(held.pop(0))

    for p in parts:
        if len(p) > size:
            if held:
                close()
                held, length = [], 0
            out += recursive(p, size, overlap, separators[at + 1 :] or ("",))
            continue
        if length + len(p) > size and held:
            close()
            while held and length + len(p) > size:
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if "".join(held).strip():
        out.append("".join(held).strip())
    return out


def by_tokens(text: str, size: int = 400, overlap: int = 50) -> list[str]:
    """Sentences packed up to `size` tokens; the last sentences of a chunk begin the next, up to `overlap` tokens."""
    out, held = [], []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if held and sum(map(tokens, held)) + tokens(sentence) > size:
            out.append(" ".join(held).strip())
            kept = []
            for s in reversed(held):
                if sum(map(tokens, kept)) + tokens(s) > overlap:
                    break
                kept.insert(0, s)
            held = kept
        held.append(sentence)
    last = " ".join(held).strip()
    return out + [last] if last else out


def by_structure(text: str, least: int = 10) -> list[str]:
    """Pieces between headings with more than `least` characters; by tokens where there is one piece at most."""
    cuts = sorted({m.start() for p in HEADINGS for m in re.finditer(p, text)} | {0, len(text)})
    out = [p for a, b in zip(cuts, cuts[1:]) if len(p := text[a:b].strip()) > least]
    return out if len(out) > 1 else by_tokens(text)


def intelligent(text: str, size: int = 400) -> list[str]:
    """By structure, and the pieces that are too long again by tokens."""
    return [c for p in by_structure(text) for c in (by_tokens(p, size) if tokens(p) > size else [p])]


def _span(text: str) -> tuple[int, int, bool] | None:
    """(start, end, whole) of the first array or object; not whole if the text ends before it does."""
    start = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    depth, quoted = 0, False
    for i in range(start, len(text)):
        c = text[i]
        if c == '"' and text[i - 1 : i] != "\\":
            quoted = not quoted
        elif not quoted and c in "[{":
            depth += 1
        elif not quoted and c in "]}":
            depth -= 1
            if not depth:
                return start, i + 1, True
    return start, len(text), False


def completed(text: str) -> str:
    """A text that breaks off, with its open string, value, objects and arrays closed."""
    open_, quoted = [], False
    for i, c in enumerate(text):
        if c == '"' and text[i - 1 : i] != "\\":
            quoted = not quoted
        elif not quoted and c in "[{":
            open_.append("]" if c == "[" else "}")
        elif not quoted and c in "]}" and open_:
            open_.pop()
    out = text + ('"' if quoted else "")
    out = re.sub(r"[,\s]+$", "", out)
    return out + (" null" if out.endswith(":") else "") + "".join(reversed(open_))


def _readings(piece: str, whole: bool):
    """A piece repaired step by step."""
    fixed = piece.translate({0x201C: '"', 0x201D: '"', 0x201E: '"', 0x2018: "'", 0x2019: "'"})
    yield re.sub(r",\s*([\]}])", r"\1", fixed)
    keyed = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', fixed)
    for one in (keyed, re.sub(r"'([^'\"]*)'", r'"\1"', keyed)):
        yield re.sub(r",\s*([\]}])", r"\1", one)
        while not whole and one:  # close it, else without its last, broken part
            yield completed(one)
            one = one[: max(one.rfind(","), 0)]


def _parsed(text: str):
    """(value,) of JSON, else nothing."""
    try:
        return (json.loads(text),)
    except ValueError:
        return ()


def salvage_json(text: str):
    """The first array or object in a text, repaired if need be; null if there is none.

    Code fences go. Of an array that breaks off, the flat objects that are whole are kept.
    Else typographic and single quotes, trailing commas and bare keys are repaired, and
    what breaks off is closed; where all that fails, the flat objects that parse are kept.
    """
    bare = re.sub(r"```[a-z]*", "", text)
    span = _span(bare)
    if not span:
        return None
    start, end, whole = span
    piece = bare[start:end]
    readings = chain([piece], _readings(piece, whole))
    first = list(islice(readings, 3))
    flat = [v for r in first if (found := re.findall(r"\{[^{}]*\}", r)) for v in [[x for f in found for x in _parsed(f)]] if v]
    kept = max(flat, key=len, default=None)
    if not whole and piece[0] == "[" and kept:
        return json.dumps(kept, ensure_ascii=False, sort_keys=True)
    value = next((v[0] for v in map(_parsed, chain(first, readings)) if v), kept)
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def ratio(a: str, b: str) -> int:
    """Similarity in per cent: the best of the whole texts, the best window of the longer one and the sorted words."""
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0
    whole = lambda x, y: round(100 * SequenceMatcher(None, x, y, autojunk=False).ratio())
    short, long = sorted((a, b), key=len)
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()}
    part = max(whole(short, long[s : s + len(short)]) for s in starts)
    return max(whole(a, b), part, whole(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def _arrow(function, kind: T.DataType, arrow: pa.DataType):
    def column(c: Column, *args) -> Column:
        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if (t := v.as_py()) is None else function(t, *args) for v in x], arrow)

        run.__annotations__ = {"x": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, kind)(c)

    return column


_LIST = (T.ArrayType(T.StringType()), pa.list_(pa.string()))
chunk_recursive, chunk_tokens = _arrow(recursive, *_LIST), _arrow(by_tokens, *_LIST)
chunk_structure, chunk_intelligent = _arrow(by_structure, *_LIST), _arrow(intelligent, *_LIST)
json_extract = _arrow(salvage_json, T.StringType(), pa.string())


def fuzzy(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if (p := i.as_py()) is None or (r := j.as_py()) is None else ratio(p, r) for i, j in zip(x, y)], pa.int32())

    run.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.IntegerType())(a, b)
