"""Run logs as streams (survey X1-X5), and windows over event tables as an extension.

The reference appends rows to logs and resumes by the ids that it finds there; these are the streaming counterparts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, kind: str = "json") -> DataFrame:
    """New files of a log folder; ``files_per_trigger`` paces the work."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append as JSON lines, exactly once by the checkpoint; runs until all present input is done."""
    return rows.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def once_per_id(rows: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row per id within the delay; state for older ids is dropped."""
    # The source tables carry times without a zone, which a watermark does not take.
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet; failed rows have none, so they are tried again."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def attempt_states(attempts: DataFrame, key: str, order: Sequence[str], error: str) -> DataFrame:
    """The keyed state of a resumed run, of a table or of a stream in update mode.

    ``attempts`` are log rows, ``error`` is null for a trajectory. An id with a trajectory is done for good, with the
    first one in ``order``; one that has only failed stays open and keeps its last error. ``failures`` counts its
    errors. On a stream the state has no expiry; attempts of one id combine before the shuffle, so an id that is tried
    very often is no hot spot. Rows with a null id are left out, as no later run could ask for them.
    """
    rest = [c for c in attempts.columns if c not in (key, error)]
    failed = F.col(error).isNotNull()
    at = [F.col(c).alias(f"k{n}") for n, c in enumerate(order)]
    first = F.min(F.when(~failed, F.struct(*at, F.struct(*rest).alias("row"))))
    last = F.max(F.when(failed, F.struct(*at, F.col(error).alias("error"))))
    named = attempts.where(F.col(key).isNotNull())
    return named.groupBy(key).agg(first.alias("first"), last.alias("last"), F.count_if(failed).alias("failures"))


def attempt_table(states: DataFrame, key: str, rest: Sequence[str]) -> DataFrame:
    """One row per id: ``done``, the columns ``rest`` of its trajectory if it is done, else its last error."""
    done = F.col("first").isNotNull()
    return states.select(key, done.alias("done"), *[F.col("first.row")[c].alias(c) for c in rest], F.when(~done, F.col("last.error")).alias("last_error"), "failures")


#: Settings of keyed state on disk, with memory and disk bounded for many small stores.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def follow_attempts(attempts: DataFrame, key: str, order: Sequence[str], error: str, folder: str) -> StreamingQuery:
    """X2 on a stream: take all attempts that the state in ``folder`` has not seen; runs until the present input is done.

    Each batch writes the ids that it changed, a repeated one over itself; ``followed`` reads what holds now. A run that
    was stopped goes on from its checkpoint.
    """
    spark = attempts.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/ids/batch={number}")

    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        states = attempt_states(attempts, key, order, error)
        return states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        # The query keeps the settings that it was started with.
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def followed(spark: SparkSession, folder: str, key: str, rest: Sequence[str]) -> DataFrame:
    """``attempt_table`` of all ids, by the latest batch that changed each."""
    changed = spark.read.parquet(f"{folder}/ids")
    latest = changed.groupBy(key).agg(F.max_by(F.struct("first", "last", "failures"), "batch").alias("s")).select(key, "s.*")
    return attempt_table(latest, key, rest)


def still_open(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The requested rows that a resumed run tries: all but the done ones, with their last error if they have one."""
    told = table.select(F.col(key).alias("__key"), "done", "last_error", "failures")
    joined = requested.join(told, F.col(key) == F.col("__key"), "left").where(~F.coalesce("done", F.lit(False)))
    return joined.withColumn("failures", F.coalesce("failures", F.lit(0))).drop("__key", "done")


def run_summary(rows: DataFrame, by: str) -> DataFrame:
    """Counts kept up to date while rows arrive (complete or update mode)."""
    good = F.coalesce(F.col("passed"), F.lit(False))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("processed"), F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"))


def split_sink(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """S18 on a stream: each batch into raw, filtered and failed; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        good = F.coalesce(F.col("passed"), F.lit(False))
        for name, part in (("raw", batch), ("filtered", batch.where(good)), ("failed", batch.where(~good))):
            part.write.mode("overwrite").json(f"{path}/{name}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Heartbeat(StreamingQueryListener):
    """The last progress of each query."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.last[str(event.id)] = {"state": "started"}

    def onQueryProgress(self, event):
        self.last[str(event.progress.id)] = {"state": "running", "batch": event.progress.batchId, "rows": event.progress.numInputRows}

    def onQueryIdle(self, event):
        self.last.setdefault(str(event.id), {})["state"] = "idle"

    def onQueryTerminated(self, event):
        self.last[str(event.id)] = {"state": "failed" if event.exception else "done"}


def windowed_counts(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Extension: tumbling or sliding counts with a watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return timed.groupBy(window, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Extension: session windows per key."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), key, "n")
