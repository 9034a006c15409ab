"""Where intermediate results live: the folder the cluster shares, never one machine's disk."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of our own if all runs on this machine, else an error."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def _gone_at_end(spark: SparkSession, path: str) -> None:
    """Have a table deleted when the driver's JVM ends: results are lazy, so it may be needed until then."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet under the shared folder and read back: columnar, compressed, re-readable."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _gone_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """End the plan of a small table that a loop goes on with.

    A written table rather than checkpoint(): a checkpoint keeps the size that was estimated for its plan, and estimates
    of joins of joins multiply from round to round beyond any number; files have the size they have.
    """
    return table(df, "cut")
