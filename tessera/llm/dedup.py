"""Exact deduplication as a stateful stream.

Texts are equal when they are the same after each run of ASCII white space has become one space. The stream reads
fingerprints (digest, identifier, content locator); its keyed state, on disk in RocksDB and without expiry, keeps for
each digest the smallest identifier with its locator (file and row in it) and the number of rows. Every batch tells
which entries it changed. Texts stay where they are: the state holds none.

A hit is a row whose digest has other rows. Hits are checked by their full bytes: those of one digest are grouped by
their whole text, and the content at the entry's locator must be the only one. Equal texts combine before the shuffle,
so a group of very many copies moves once per task. Digests with several contents fall back to one entry per content.

Defined cases: a null text is empty; null ids rank after all others, and a group of null ids alone keeps one row with a
null id; of repeated rows (same id, same text) exactly one, the first by locator, is kept; an empty table gives an
empty result; other columns are ignored. A text of any length is one value; its row must fit a task.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, join_sized, materialise, shared_dir

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of fingerprint files that one batch of the stream takes.
BATCH_BYTES = 256 << 20
#: Bytes of the SHA-256 that key the state; fewer make clashes, which the check of the bytes resolves.
DIGEST_BYTES = 32
SEEN = "doc_id long, sha binary, file string, row long"
ENTRY = "digest binary, first struct<unnamed:boolean,doc_id:long,file:string,row:long>, size long"
#: Settings of the keyed state; its memory outside the heap is bounded for an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Disk is not reserved ahead: some megabytes for each of the many state stores.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def located(docs: DataFrame) -> DataFrame:
    """Identifier, text and content locator; rows that no file holds are written to the shared folder first."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", place.getField("file_path").alias("file"), place.getField("row_index").alias("row"))
    except AnalysisException:
        return located(materialise(docs.select("doc_id", "text"), "dedup-texts"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """SEEN rows of ``located`` documents, of a table or of a stream."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"), "file", "row")


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """STATE while a query starts; the query keeps what it started with."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _key(digest_bytes: int) -> Column:
    return F.substring("sha", 1, digest_bytes).alias("digest")


def ingest(spark: SparkSession, seen: str, state: str, digest_bytes: int = DIGEST_BYTES, batch_bytes: int = BATCH_BYTES) -> None:
    """Take the fingerprint files of folder ``seen`` that the state in folder ``state`` has not taken yet.

    The folder keeps the stream's checkpoint with the keyed state, and the entries that each batch changed. A batch that
    is repeated after a failure overwrites its own entries.
    """
    rows = spark.readStream.schema(SEEN).option("maxBytesPerTrigger", str(batch_bytes)).parquet(seen)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")).alias("first")
    entries = rows.groupBy(_key(digest_bytes)).agg(first, F.count(F.lit(1)).alias("size"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/entries/batch={batch}")

    with _settings(spark):
        query = entries.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def entries(spark: SparkSession, state: str) -> DataFrame:
    """ENTRY rows: what the state holds now, by the latest batch that changed each digest."""
    changed = spark.read.schema(f"{ENTRY}, batch long").parquet(f"{state}/entries")
    latest = changed.groupBy("digest").agg(F.max_by(F.struct("first", "size"), "batch").alias("last"))
    return latest.select("digest", "last.first", "last.size")


def _differing(docs: DataFrame, several: DataFrame, digest_bytes: int) -> DataFrame:
    """The digests whose rows have another content than the one that the entry locates.

    Up to BROADCAST_BYTES of digests only hits are grouped; beyond, all rows are, still combined before the shuffle.
    """
    rows = docs.select(normalised(F.col("text")).alias("whole"), "file", "row").withColumn("sha", F.unhex(F.sha2("whole", 256)))
    rows = rows.select(_key(digest_bytes), "whole", "file", "row")
    named = several.select(F.col("digest").alias("of"), F.col("first.file").alias("at_file"), F.col("first.row").alias("at_row"))
    if several.count() * 200 <= BROADCAST_BYTES:
        hits = rows.join(F.broadcast(named), F.col("digest") == F.col("of"))
        own = (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))
        contents = hits.groupBy("digest", "whole").agg(F.max(own).alias("own"))
        return contents.where(~F.col("own")).select("digest").distinct()
    contents = rows.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("rows"))
    return contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")


def decide(docs: DataFrame, seen: DataFrame, found: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """A row per document: doc_id, file, row, sha, keep_id, group_size, kept.

    ``docs``: located documents; ``seen``: their fingerprints; ``found``: the entries of the state.
    """
    several = materialise(found.where("size > 1"), "dedup-several")
    clashes = materialise(_differing(docs, several, digest_bytes), "dedup-clashes")
    rows = seen.withColumn("digest", F.substring("sha", 1, digest_bytes))
    told = ["doc_id", "file", "row", "sha"]
    clashing = clashes.count()
    if clashing:
        several = several.join(clashes, "digest", "left_anti")
        apart = rows.join(clashes, "digest", "left_semi")
        rows = rows.join(clashes, "digest", "left_anti")
    joined = join_sized(rows, several.select("digest", "first", "size"), "digest", "size", 200)
    own = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    out = joined.select(
        *told,
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(own, F.lit(True)).alias("kept"),
    )
    if not clashing:
        return out
    # Different texts of one digest: whole texts decide, for the rows of these digests alone.
    whole = docs.select("file", "row", normalised(F.col("text")).alias("whole"))
    texts = apart.join(whole, ["file", "row"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")).alias("first")
    each = texts.groupBy("whole").agg(first, F.count(F.lit(1)).alias("size"))
    exact = texts.join(each, "whole").select(*told, F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), own.alias("kept"))
    return out.unionByName(exact)


def deduplicate(docs: DataFrame, digest_bytes: int = DIGEST_BYTES, batch_bytes: int = BATCH_BYTES, state: str | None = None) -> DataFrame:
    """All rows of ``docs`` with their decisions; ``state`` names a folder whose state goes on, else a new one is made."""
    spark = docs.sparkSession
    state = state or shared_dir(spark, "dedup-state")
    seen = shared_dir(spark, "dedup-seen")
    texts = located(docs)
    fingerprints(texts).write.parquet(seen)
    ingest(spark, seen, state, digest_bytes, batch_bytes)
    return decide(texts, spark.read.schema(SEEN).parquet(seen), entries(spark, state), digest_bytes)
