"""A training corpus from raw documents: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, packing, quality, substring, toxicity
from graphloom.llm.common import forget, materialize, may_hold, raw, small_batches
from graphloom.llm.queries import CAPACITY, PACK_END, tokenizer_path

#: Scores from which a document is toxic, and from which it is good enough.
TOXIC, GOOD = 0.5, 0.3
#: Word shingles and similarity of near-duplicates.
SHINGLE, PER_CENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier lets pass; null texts score like empty ones.

    Rows are judged one by one, so repeated rows go or stay together; all columns stay.
    """
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score(model) < TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on what is left of the labelled ones, lets pass.

    Rows are judged one by one, so repeated rows go or stay together; all columns stay.
    """
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score(model) >= GOOD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the first by id and text hash.

    Rows are told apart by id and text: rows that share an id are compared like any
    others, rows that agree in both are copies, of which one stays. Documents with a null
    id stay all. Columns named like the ones used here (__row) are not expected.
    """
    small_batches(spark)
    named = docs.withColumn("__row", F.xxhash64("doc_id", F.col("text").cast("string")))
    known = named.filter("doc_id is not null")
    groups = jaccard.join(known, "__row", "text", SHINGLE, PER_CENT).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component")).distinct()
    rows = known.groupBy("doc_id", "__row").agg(F.count("*").alias("copies")).join(groups, "__row")
    rows = materialize(rows, "near-rows")
    first = F.min(F.struct("doc_id", "__row")).alias("first")
    several = rows.groupBy("component").agg(first, F.count("*").alias("n"), F.max("copies").alias("copies")).filter("n > 1 or copies > 1")
    decided = rows.join(several.select("component", "first"), "component").select("doc_id", "__row", (F.struct("doc_id", "__row") == F.col("first")).alias("__kept"))
    decided = materialize(decided, "near-decided")
    forget(rows)
    asked = may_hold(decided, "__row", "__row")
    one = known.filter(asked).join(decided, ["doc_id", "__row"], "left").filter("__kept is null or __kept").dropDuplicates(["doc_id", "__row"])
    rest = known.filter(~asked).unionByName(named.filter("doc_id is null"))
    return rest.select(docs.columns).unionByName(one.select(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; n_chars follows the text."""
    small_batches(spark)
    left = substring.remove(docs, substring.find(docs, within=False))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: see graphloom.llm.packing."""
    small_batches(spark)
    return packing.pack(docs, "doc_id", raw("text"), CAPACITY, bpe.library_encoder(tokenizer_path(), PACK_END))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack_tokens),
]

#: The classifiers and the sketches of the stages have no SQL form; tests hold each stage against what it must do, the near copies and packing by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
