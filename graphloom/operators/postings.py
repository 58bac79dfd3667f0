"""An inverted text index: of each term the documents, how often, where, and how long they are.

The postings lie in folders by the term's hash and are sorted by term, so that a search
reads the row groups of its terms and no texts. Ranking is BM25 over the stored lengths;
phrases are told by the stored places. Terms are runs of letters and digits in lower
case.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.files import shared_path

TERM = r"[\p{L}\p{N}]+"
#: Saturation of repeated terms and weight of lengths in BM25 (the usual values); folders of the postings.
K1, B, PARTS = 1.2, 0.75, 32


def terms(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Postings:
    """A stored index over documents told apart by `keys`; n of them have terms, `average` in the mean."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    n: int
    average: float

    def of(self, asked: Sequence[str]) -> DataFrame:
        """The postings of some terms: term, keys, tf, places, length."""
        asked = sorted(set(asked))
        parts = self.spark.createDataFrame([(t,) for t in asked], "term string").select(_part(F.col("term"))).distinct().collect()  # one row per term
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")
        return rows.filter(F.col("part").isin([p[0] for p in parts]) & F.col("term").isin(asked))

    def frequencies(self, asked: Sequence[str]) -> dict[str, int]:
        """In how many documents some terms are."""
        rows = self.spark.read.schema("term string, df long").parquet(f"{self.path}/terms").filter(F.col("term").isin(sorted(set(asked))))
        return {r["term"]: r["df"] for r in rows.collect()}  # one row per term asked


def write_index(docs: DataFrame, keys: Sequence[str], text: str = "text") -> Postings:
    """An index in the shared folder; each row is a document, its keys tell it from others, null texts have no terms."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "postings")
    words = docs.select(*keys, terms(F.col(text)).alias("t")).select(*keys, F.size("t").cast("long").alias("length"), F.posexplode("t").alias("place", "term"))
    rows = words.groupBy("term", *keys).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("places"), F.first("length").alias("length"))
    dealt = rows.withColumn("part", _part(F.col("term")))
    # a frequent term's documents are spread over several files of its folder
    dealt.repartition("part", F.pmod(F.xxhash64(*keys), F.lit(4))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/postings")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange(F.col("term")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    facts = docs.select(F.size(terms(F.col(text))).alias("n")).filter("n > 0").agg(F.count("*").alias("n"), F.avg("n").alias("average")).first()
    return Postings(spark, path, tuple(keys), dealt.schema, facts["n"], facts["average"] or 0.0)


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def follows(places: Column, phrase: Sequence[str]) -> Column:
    """Whether the terms of a phrase stand next to each other; places: a map of the terms' places."""

    def starts(i: int) -> Column:
        of_term = F.coalesce(F.try_element_at(places, F.lit(phrase[i])), F.array().cast("array<int>"))
        return F.transform(of_term, lambda p: p - F.lit(i))

    return F.size(reduce(F.array_intersect, map(starts, range(len(phrase))))) > 0


def search(index: Postings, asked: Sequence[str], every: bool = False, phrases: Sequence[Sequence[str]] = ()) -> DataFrame:
    """keys, score, matched: documents with any (or every) of the terms and all of the phrases, with their BM25 and how many of the terms they have."""
    wanted = sorted({*asked, *(t for p in phrases for t in p)})
    df = index.frequencies(wanted)
    weight = reduce(lambda c, t: c.when(F.col("term") == t, F.lit(idf(index.n, df[t]))), sorted(df), F.when(F.lit(False), 0.0)).otherwise(0.0)
    tf = F.col("tf").cast("double")
    score = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(index.average or 1.0)))
    aggregates = [F.sum("s").alias("score"), F.count_if(F.col("term").isin(sorted(set(asked)))).alias("matched")]
    if phrases:
        aggregates.append(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("where"))
    found = index.of(wanted).withColumn("s", score).groupBy(*index.keys).agg(*aggregates)
    if every:
        found = found.filter(F.col("matched") == len(set(asked)))
    for p in phrases:
        found = found.filter(follows(F.col("where"), p))
    return found.select(*index.keys, "score", "matched")
