"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/landmarq"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts lineage: the table outlives any executor.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)  # noqa: SLF001
