"""Where jobs may keep what all executors must see."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster names no folder that all its machines see."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, one below the warehouse, but only if the
    whole session runs on one machine: a cluster must name its folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "quillgraph-work")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once into a table in the shared folder, so that plans which use them often read them there.

    Unlike a cache it survives the loss of executors without computing again.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that no plan reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
