"""Where intermediate tables are kept: a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + _local_root()
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _local_root() -> str:
    """One folder for each driver process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="deltaloom-staging-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stage(df: DataFrame, name: str = "slice", writers: int = 0) -> DataFrame:
    """``df`` written once and read back: cheap to scan again, safe from lost executors.

    The files go when the application ends, or by ``unstage``.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/deltaloom/{name}-{uuid.uuid4().hex}"
    (df.repartition(writers) if writers else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out._staged = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes what ``stage`` wrote for ``df``, which no plan may read again; other frames are left alone."""
    if path := getattr(df, "_staged", None):
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)
