"""Sources and sinks (survey S1-S19, H1)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow_ipc import ArrowIpc


def resolve_path(template: str, roots: Mapping[str, str]) -> str:
    """``__NAME__`` marks in a path are replaced."""
    for name, value in roots.items():
        template = template.replace(f"__{name}__", value)
    return template


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType | str, limit: int | None = None, ordinal: bool = True) -> DataFrame:
    """JSON lines with ``line_no``, the order within the files; the first ``limit`` rows of the order.

    Text files are split at file and block bounds in order, so (file, block start, position in the block) is file order;
    ranks are sums over a table of one row per block, not one global window.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).withColumn("m", F.monotonically_increasing_id())
    rows = lines.where(F.trim("value") != "")
    parsed = rows.select("file", "start", "m", F.from_json("value", schema).alias("r"))
    if not ordinal:
        return parsed.select("r.*")
    part = F.shiftright("m", 33)
    counts = rows.groupBy("file", "start", part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = Window.orderBy("file", "start", "p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("file").alias("f"), F.col("start").alias("s"), "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "start", part).orderBy("m")) - 1
    placed = parsed.withColumn("i", inside).join(offsets, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")) & (part == F.col("p")))
    out = placed.select("r.*", (F.col("before") + F.col("i")).alias("line_no"))
    return out if limit is None else out.where(F.col("line_no") < limit)


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet or JSON lines by suffix, files in the order listed as ``src_priority``; other suffixes fail."""
    out = None
    for k, path in enumerate(paths):
        if path.endswith(".parquet"):
            part = spark.read.parquet(path)
        elif path.endswith((".jsonl", ".json")):
            part = spark.read.json(path)
        elif path.endswith(".arrow"):
            part = read_arrow(spark, path)
        else:
            raise ValueError(f"unsupported file: {path}")
        part = part.withColumn("src_priority", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_arrow(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Arrow IPC streams or files, a file or a folder of them, by the data source ``arrow_ipc``."""
    spark.dataSource.register(ArrowIpc)
    reader = spark.read.format("arrow_ipc").option("path", path)
    return (reader if split_bytes is None else reader.option("splitBytes", str(split_bytes))).load()


def eval_ids(spark: SparkSession, path: str, column: str = "id", tolerant: bool = False) -> DataFrame:
    """Distinct ids; a missing file gives none where ``tolerant``."""
    try:
        rows = spark.read.json(path)
        return rows.select(F.col(column).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
    except Exception as error:
        if tolerant and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], "id string")
        raise


def read_config(path: str) -> dict:
    """A small JSON file, on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """S13, S14."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_report(row: DataFrame, path: str) -> dict:
    """One row of aggregates as indented JSON."""
    report = row.first().asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, default=str)
    return report


def write_nested(rows: DataFrame, path: str) -> None:
    """S16."""
    rows.write.mode("overwrite").parquet(path)


def write_partitioned(rows: DataFrame, path: str, by: str, passed: Column) -> None:
    """Raw, filtered and failed tables, each partitioned; the input is computed once."""
    held = rows.withColumn("__passed", F.coalesce(passed, F.lit(False)))
    held.write.mode("overwrite").partitionBy(by).parquet(f"{path}/raw")
    again = held.sparkSession.read.parquet(f"{path}/raw")
    again.where("__passed").drop("__passed").write.mode("overwrite").partitionBy(by).parquet(f"{path}/filtered")
    again.where("NOT __passed").drop("__passed").write.mode("overwrite").partitionBy(by).parquet(f"{path}/failed")


def cached_table(spark: SparkSession, path: str, make: Callable[[], DataFrame], expected: int | None = None, overwrite: bool = False) -> DataFrame:
    """A written table if it is there (and has the expected rows), else made and written."""
    if not overwrite:
        try:
            found = spark.read.parquet(path)
            if expected is None or found.count() == expected:
                return found
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
