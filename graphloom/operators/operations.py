"""Operational analytics: ingestion jobs and files, progress events, file archives and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys, order) -> DataFrame:
    """The last row of each key, by a max_by that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__l"))
    return best.select(*keys, "__l.*")


def job_status(done: Column, failed: Column) -> Column:
    return F.when(failed == 0, "Completed").when(done > 0, "Completed with Errors").otherwise("Failed")


def failure_class(message: Column) -> Column:
    """Class of an error message: the first rule that fits."""
    low = F.lower(message)
    rules = [("ocr", "Failed - OCR"), ("extract", "Failed - Extraction"), ("neo4j", "Failed - Graph Storage"), ("vector", "Failed - Vector Storage"), ("cache", "Failed - Cache")]
    return F.coalesce(*[F.when(low.contains(w), F.lit(c)) for w, c in rules], F.lit("Failed"))


def stage_durations(events: DataFrame, keys, ts: str, order) -> DataFrame:
    """Each event with the seconds until the next of its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("seconds", (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)


def with_updates(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of base with the non-null columns of at most one update per key."""
    new = updates.select(key, *[F.col(c).alias("__" + c) for c in updates.columns if c != key])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce("__" + c, c).alias(c) if "__" + c in joined.columns else F.col(c) for c in base.columns])


def search(messages: DataFrame, asked: str, text: str = "text") -> DataFrame:
    """Messages that hold the term, with its number of hits as the score."""
    hits = (F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(asked.lower()), F.lit("")))) / len(asked)
    return messages.filter(F.col(text).ilike(f"%{asked}%")).withColumn("hits", hits.cast("long"))
