"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "permspark.work.dir"
_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get(KEY, None)
    if not found:
        if conf.get("spark.master", "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="permspark-work-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and read back: later steps start from files, not from its plan."""
    path = f"{work_dir(df.sparkSession)}/ply-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that cut() has written in this process; results not yet read are lost with it."""
    jvm = spark.sparkContext._jvm
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
