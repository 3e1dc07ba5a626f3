"""Session defaults and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for sessions that this package builds itself. A session that is passed in is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tessera", cpus: int | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter builds the session and sets its own master."""
    builder = SparkSession.builder.master(f"local[{cpus or os.cpu_count()}]").appName(app)
    merged = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} | conf
    return builder.config(map=merged).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set otherwise.

    Where neither is set, a temporary folder is made on a local master; on a cluster it would be of no use to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Folders that this application has made in the shared folder.
_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder, see ``clear_written``."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once the results that read them are written."""
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: Path) -> None:
    """Send the package's modules to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.glob("tessera/**/*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
