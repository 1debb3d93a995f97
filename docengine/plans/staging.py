"""Staged tables in the shared checkpoint folder, and joins chosen by measured size."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest staged table, in bytes on disk, that is sent to every executor.
BROADCAST_BYTES = 16 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one of this machine where it is unset and Spark runs here alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docengine-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that later plans start from the files."""
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this application. Call it when the results that were made of them have been written or read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*staged: DataFrame) -> None:
    """Delete tables made by stage(), when all that was made of them has been staged itself."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table made by stage()."""
    spark = df.sparkSession
    total = 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Stage df and mark it for broadcast if its measured size is within limit; else leave the join to shuffle."""
    staged = stage(df)
    return F.broadcast(staged) if staged_bytes(staged) <= limit else staged


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_with_tasks(module_name: str) -> None:
    """Send the module's functions to Python workers by value, so that executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
