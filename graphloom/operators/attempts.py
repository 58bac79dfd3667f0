"""Outside models asked in bounded attempts: what fails is asked again, what stays failed is kept with its reason.

Each attempt is a pass over what is left of the rows and is stored before the next one
begins, so a lost executor repeats a task of one attempt and no answer is asked for twice
when it has been stored. Replies are judged by a parser; a provider may raise Quota.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.functions.chunkers import salvage_json
from graphloom.operators.plugins import Provider
from graphloom.sources.store import forget, stored

#: (value, None) of a good reply, (None, reason) of another.
Parser = Callable[[str], tuple[str | None, str | None]]


class Quota(Exception):
    """The provider takes no more for now."""


def _replies(provider: Provider, texts: list[str], attempt: int) -> list[tuple[str | None, str | None]]:
    try:
        at = getattr(provider, "answer_at", None)
        return [(r, None) for r in (at(texts, attempt) if at else provider.answer(texts))]
    except Quota:
        return [(None, "quota")] * len(texts)
    except Exception as e:  # a provider's failure is a row's, not the job's
        return [(None, f"error: {type(e).__name__}")] * len(texts)


def ask_again(rows: DataFrame, keys: Sequence[str], text: str, provider: Provider, parse: Parser, most: int = 2, per_second: float | None = None, at_once: int = 16) -> tuple[DataFrame, DataFrame]:
    """(accepted: keys, attempt, value; rejected: keys, attempt, reason), stored.

    Each row is asked for at most `most` times, `at_once` texts a call; with `per_second`,
    a task sends no more texts than that. Keys tell rows apart; null texts are asked as empty.
    """
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "attempt int, value string, reason string"])

    def call(attempt: int):
        def run(batches):
            begun, sent = time.monotonic(), 0
            for batch in batches:
                for i in range(0, batch.num_rows, at_once):
                    part = batch.slice(i, at_once)
                    if per_second:
                        time.sleep(max(0.0, sent / per_second - (time.monotonic() - begun)))
                    sent += part.num_rows
                    values, reasons = [], []
                    for reply, reason in _replies(provider, [t or "" for t in part.column(len(keys)).to_pylist()], attempt):
                        value, why = (None, reason) if reason else parse(reply or "")
                        values.append(value if not why else None)
                        reasons.append(why)
                    cells = [part.column(k) for k in range(len(keys))]
                    cells += [pa.array([attempt] * part.num_rows, pa.int32()), pa.array(values, pa.string()), pa.array(reasons, pa.string())]
                    yield pa.RecordBatch.from_arrays(cells, names=[*keys, "attempt", "value", "reason"])

        return run

    left, passes = stored(rows.select(*keys, text), "asked"), []
    for attempt in range(1, most + 1):
        passes.append(stored(left.mapInArrow(call(attempt), schema), "replies"))
        failed = passes[-1].filter("reason is not null").select(*keys)
        if attempt == most or failed.isEmpty():
            break
        rest = stored(left.join(failed, list(keys), "left_semi"), "asked")
        forget(left)
        left = rest
    forget(left)
    every = reduce(DataFrame.unionByName, passes)
    return every.filter("reason is null").drop("reason"), every.filter("reason is not null").drop("value")


def triples_in(reply: str) -> tuple[str | None, str | None]:
    """The whole triples of a reply as a JSON array: a subject, a predicate of at most three words and an object."""
    if not reply.strip():
        return None, "empty"
    found = salvage_json(reply)
    if found is None:
        return None, "no json"
    rows = json.loads(found)
    rows = [r for r in (rows if isinstance(rows, list) else [rows]) if isinstance(r, dict)]
    whole = [{k: str(r[k]).strip() for k in ("subject", "predicate", "object")} for r in rows if all(str(r.get(k) or "").strip() for k in ("subject", "predicate", "object"))]
    good = [r for r in whole if len(r["predicate"].split()) <= 3]
    return (json.dumps(good, ensure_ascii=False), None) if good else (None, "no triples")


def text_in(reply: str) -> tuple[str | None, str | None]:
    return (reply, None) if reply.strip() else (None, "empty")
