"""Session settings and the shared folder that holds cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a side that may be broadcast after its size was counted. A row of two or three BIGINTs takes about 60 bytes
#: in a broadcast hash relation, so this bounds a broadcast at about 30 MB.
BROADCAST_ROWS = 500_000


def create_session(app: str = "kinograph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling; ``conf`` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (tests), a temporary folder is made and set; on a cluster an unset folder
    is an error, since a machine-local folder would lose data with its machine.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="kinograph-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans it
        pass


def written(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage is cut and survives lost executors.

    The files are needed for as long as the returned frame is used; they are deleted by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"kinograph-{name}-{uuid.uuid4().hex}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    atexit.register(_delete, spark, path)
    result = spark.read.schema(df.schema).parquet(path)
    result._kinograph_path = path
    return result


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by ``written``, which nothing uses any more. Other frames are left alone."""
    path = getattr(df, "_kinograph_path", None)
    if path:
        _delete(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_kinograph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kinograph-code-")) / "kinograph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._kinograph_shipped = True


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
