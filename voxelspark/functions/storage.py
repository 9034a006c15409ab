"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir`` (where that is unset: in a folder of our own if all runs on this machine, else an error).

    Results are lazy, so what is written there is needed as long as the session may read it: it goes when the driver's JVM ends.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write and read back: the plan starts anew and survives lost executors.

    A written table rather than checkpoint(): a checkpoint keeps the size that was estimated for its plan, and estimates
    of joins of joins multiply from round to round beyond any number.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
