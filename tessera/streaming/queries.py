"""Streams that run until their present input is done and give a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder

from . import logs


def summarise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: one row per event id within the watermark, then counts by type over all batches.

    Each batch writes its own counts, a repeated one over itself, and the counts of all batches are added up.
    """
    folder = shared_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("passed", F.col("value") > 20)
    once = logs.once_per_id(rows, "event_id", "ts")

    def keep(batch: DataFrame, number: int) -> None:
        logs.run_summary(batch, "event_type").write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    # An input without rows makes no batch, but its summary has columns.
    keep(spark.createDataFrame([], once.schema), -1)
    query = once.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = spark.read.parquet(f"{folder}/table").groupBy("event_type")
    return counts.agg(*[F.sum(c).alias(c) for c in ("processed", "passed", "failed")])


def resume_attempts(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Events as the log of a run: a user's hours are ids, events attempts, ``error`` events runtime errors.

    The log is written as files, which the stream takes in several batches; state is keyed by id and kept for good.
    """
    folder = shared_folder(spark, "stream")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    failed = F.when(F.col("event_type") == "error", F.coalesce("props", F.lit("error")))
    named = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.hour("ts").cast("string"))
    log = rows.select(named.alias("id"), "ts", "event_id", "event_type", "value", failed.alias("error"))
    log.repartition(2 * batches, "event_id").write.parquet(f"{folder}/log")
    attempts = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    logs.follow_attempts(attempts, "id", ("ts", "event_id"), "error", folder).awaitTermination()
    return logs.followed(spark, folder, "id", ("event_id", "event_type", "value"))
