"""Vector search over ARRAY<FLOAT> columns: cosine top-k, filters, batches and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(items: DataFrame, query: Sequence[float], k: int, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k items most like the query, after the filter: key, similarity, rank. A partial top-k runs in each task."""
    found = items if where is None else items.filter(where)
    scored = found.select(key, cosine(F.col(vector), literal(query)).alias("similarity")).filter("similarity is not null")
    best = scored.orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)).cast("long"))  # k rows


def top_k_batch(items: DataFrame, queries: DataFrame, k: int, least: float = -1.0, most_queries: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query (query_id, query) its k nearest items with a similarity of `least` or more.

    The queries are broadcast after their number has been checked; more of them are worked
    off in slices of the caller's making.
    """
    n = queries.count()
    if n > most_queries:
        raise ValueError(f"{n} queries at once; at most {most_queries} are broadcast")
    pairs = items.select(key, F.col(vector).alias("__v")).join(F.broadcast(queries), F.lit(True))
    scored = pairs.select("query_id", key, cosine(F.col("__v"), F.col("query")).alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def hybrid(first: DataFrame, second: DataFrame, key: str, k: int, damp: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked results (key, rank)."""
    part = lambda df: df.select(key, (1.0 / (damp + F.col("rank"))).alias("s"))
    both = part(first).unionByName(part(second)).groupBy(key).agg(F.sum("s").alias("score"))
    return both.orderBy(F.desc("score"), key).limit(k)


def entity_statistics(items: DataFrame, lists: Sequence[str], top: int = 10) -> DataFrame:
    """Per list column: items with any, mentions, distinct values, share of items, and the most frequent values."""
    total = items.count()
    long = items.select(F.explode(F.create_map(*[x for c in lists for x in (F.lit(c), F.col(c))])).alias("kind", "values"))
    held = long.groupBy("kind").agg(F.count_if(F.size("values") > 0).alias("items_with"), F.sum(F.greatest(F.size("values"), F.lit(0))).alias("mentions"))
    counts = long.select("kind", F.explode("values").alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("r", F.row_number().over(w)).groupBy("kind").agg(
        F.count("*").alias("unique"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "value", "n")))), lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), "|").alias("top")
    )
    share = F.round(F.coalesce(F.try_divide(F.col("items_with") * 100.0, F.lit(total)), F.lit(0.0)), 4)
    return held.join(ranked, "kind", "left").select("kind", "items_with", "mentions", F.coalesce("unique", F.lit(0)).alias("unique"), share.alias("coverage_percent"), F.coalesce("top", F.lit("")).alias("top"))
