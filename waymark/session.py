"""Reading the driver tables and making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[str] = []  # folders of this application


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (as ``--py-files`` does)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="waymark-"), "waymark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it; a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path below the shared folder that nobody else has."""
    _made.append(f"{shared_folder(spark)}/waymark-{uuid.uuid4().hex}")
    return _made[-1]


def stage(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared folder.

    For inputs that many plans read: they are computed once, read column by column, and
    survive the loss of executors.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the folders that :func:`stage` and :func:`new_folder` made in this application.

    For the end of a job: results that were not read yet are lost."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
