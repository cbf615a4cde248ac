"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where that is unset, a local session (as in tests) gets a temporary folder; a cluster must name one."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("kbspark.tables.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="kbspark-tables-")
        spark.conf.set("kbspark.tables.dir", got)
    return got.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop(spark, path)
    return files.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no such folder."""
    files, target = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a Parquet table and read it again: its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
