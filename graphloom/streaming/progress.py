"""Progress events as streams: latest status, windows, sessions and duplicates, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events of Parquet files in a folder, in the order the files come."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user: one row of state per user, whatever the number of events; in update mode."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"), F.max("ts").alias("ts")).select("user_id", "ts", "e.event_type", "e.value")


def run(result: DataFrame, folder: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Work off what is there into Parquet under a shared folder, and return the rows that stand in the end.

    Each batch has a folder of its own, which a repeated batch writes anew, and state that
    the watermark closes is given up in the modes append and update. Of updates the last
    batch of each key counts; of complete results the last batch.
    """
    spark = result.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    spark.createDataFrame([], result.schema).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")  # also where no file had come
    numbered = StructType([*result.schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(numbered).parquet(f"{folder}/rows")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    values = [c for c in result.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*[F.col(c if c in keys else f"last.{c}").alias(c) for c in result.columns])
