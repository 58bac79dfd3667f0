"""File sources and sinks: text with fallback decoding, triple caches, archives, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIPLE = "subject string, subject_type string, predicate string, object string, object_type string, chunk_id string, chunk_text string, inferred boolean, confidence double"


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else latin-1, which takes any bytes."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def write_archive(texts: DataFrame, path: str, end: str = "\n") -> None:
    """Files (path, value) packed as rows, for any number of them: names and bytes as read_text() reads them, `end` after each."""
    content = F.encode(F.concat(F.coalesce("value", F.lit("")), F.lit(end)), "UTF-8")
    texts.select("path", content.alias("content")).withColumn("length", F.octet_length("content").cast("long")).write.parquet(path)


def read_text(spark: SparkSession, path: str, archive: bool = False) -> DataFrame:
    """path, text, confidence, n_bytes: one row per file of any size up to 2 GB, single or packed by write_archive(); bytes are those that were read."""
    files = spark.read.schema("path string, content binary, length long").parquet(path) if archive else spark.read.format("binaryFile").load(path)
    return files.select("path", decode(F.col("content")).alias("text"), F.lit(1.0).alias("confidence"), F.octet_length("content").cast("long").alias("n_bytes"))


#: Ends a JSON text in a file of many; JSON has it in no text but escaped.
BETWEEN = "\x1e"


def write_arrays(arrays: DataFrame, path: str) -> None:
    """The only column's JSON texts, of any number of lines each, as sequences: a file per task, not per text."""
    arrays.write.option("lineSep", BETWEEN).text(path)


def read_triples(spark: SparkSession, path: str, sequences: bool = False) -> DataFrame:
    """Triples of a JSON cache: arrays of objects, one file per document, or sequences of them as write_arrays() makes."""
    reader = spark.read.schema(TRIPLE)
    return (reader.option("lineSep", BETWEEN) if sequences else reader.option("multiLine", True)).json(path)


def unique_chunks(triples: DataFrame) -> DataFrame:
    """chunk_id, chunk_text: the first text of each chunk that isn't blank."""
    w = Window.partitionBy("chunk_id").orderBy("chunk_text")
    held = triples.filter(F.trim(F.coalesce("chunk_text", F.lit(""))) != "").select("chunk_id", "chunk_text").distinct()
    return held.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def write_triple_cache(triples: DataFrame, path: str, hash_column: str) -> None:
    """One folder per file hash, so that a probe reads only that hash."""
    triples.write.mode("overwrite").partitionBy(hash_column).json(path)


def cache_misses(files: DataFrame, cached: DataFrame, hash_column: str) -> DataFrame:
    return files.join(cached.select(hash_column).distinct(), hash_column, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flatten(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """A struct column's fields as columns with a prefix."""
    names = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{n}").alias(prefix + n) for n in names])


def own_folder(spark: SparkSession) -> str:
    """A folder of our own for a local master; on a cluster one that all machines share must be named."""
    import tempfile

    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="graphloom-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or in one of our own where that is unset."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = own_folder(spark)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"
