"""What the training-data operators share: the word rule, the shared folder, intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space. ``bytes.split()`` follows the same rule on UTF-8 bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Folders that this application has made in the shared folder, by the owner in whose name they were made.
_MADE: dict[str, list[str]] = {}
_OWNERS: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession, owner: str | None = None) -> None:
    """Delete the intermediate tables and files of this application, or of one owner, once the results are written."""
    for name in [n for n in _MADE if owner is None or n == owner]:
        for folder in _MADE.pop(name):
            _delete(spark, folder)


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """Folders made inside belong to ``owner``, see ``clear_shared``."""
    _OWNERS.append(owner)
    try:
        yield
    finally:
        _OWNERS.pop()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the master is local (tests, a shell) a temporary folder becomes the checkpoint
    folder; on a cluster a folder of one machine would be of no use to the others, so its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            base = spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(_OWNERS[-1] if _OWNERS else "", []).append(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``materialise``, under a name for ``drop``."""
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        self.folders.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for folder in self.folders.pop(name, ()):
                _delete(self.spark, folder)

    def drop_all(self, but: tuple[str, ...] = ()) -> None:
        """All but the tables that a result reads."""
        self.drop(*[n for n in self.folders if n not in but])


#: Sides of a join up to this size go to all tasks; the size is counted, and beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def beside(narrow: DataFrame, width: int) -> DataFrame:
    """A written table, about ``width`` bytes a row, as the small side of a join with rows that hold texts.

    Up to BROADCAST_BYTES, by its counted rows, it is broadcast. Beyond, both sides are shuffled, and each task hashes
    its part of the narrow side instead of sorting texts; that part stays far smaller than the texts that it meets.
    """
    return F.broadcast(narrow) if narrow.count() * width <= BROADCAST_BYTES else narrow.hint("shuffle_hash")


#: A key counts as hot from a share of 1 / HOT of all rows on, so there are at most HOT hot keys.
HOT = 10_000


def join_sized(rows: DataFrame, table: DataFrame, key: str, size: str, width: int) -> DataFrame:
    """``rows`` left-joined with a written table of one row per ``key``, ``size`` rows of ``rows`` each, ``width`` bytes wide.

    Up to BROADCAST_BYTES, by its counted rows, the table is broadcast. Beyond, only its hot keys are, of which there are
    at most HOT; the rows of the others are shuffled, none with more than 1 / HOT of all rows.
    """
    names = [c for c in table.columns if c != key]
    held = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("rows")).first()
    if held.n * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, "left")
    hot = F.col(size) * HOT >= held.rows
    tagged = rows.join(F.broadcast(table.where(hot)), key, "left")
    rest = tagged.where(F.col(size).isNull()).drop(*names).join(table.where(~hot).hint("shuffle_hash"), key, "left")
    return tagged.where(F.col(size).isNotNull()).unionByName(rest)


def spare(taken: Iterable[str], name: str) -> str:
    """A column name that is not among ``taken``, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Arrow batches that hold whole texts, in bytes; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


#: What a worker keeps between tasks of one operator, by the operator's name.
HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    return HELD.setdefault(owner, {})


def _release() -> None:
    """Give free memory back to the system: workers are kept for later stages of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library: freed memory stays with the worker.
        return


def _keep_only(owner: str | None) -> None:
    """Drop what other operators hold, and give its memory back before the work of ``owner`` takes more."""
    others = [k for k in HELD if k != owner]
    for name in others:
        del HELD[name]
    if others:
        _release()


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from now on in this session."""
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not most.isdigit() or int(most) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int | None = None, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with bounded memory: batches of BATCH_BYTES for this session, cut to ``rows`` rows if asked for.

    A worker drops what it holds for other operators than ``owner`` before it begins.
    """
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(owner)
        try:
            yield from work(batches if rows is None else (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)))
        finally:
            _release()

    return df.mapInArrow(run, schema)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside nested lambdas, where a plain expression would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words, 0 for null, as bigint."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.coalesce(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit("")), F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_text(key: Column) -> Column:
    """Unsigned CRC-32 of a key written as text; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
