"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only where the session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/landmarq"

#: A word: a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go once the job has ended (nothing else reads them), and Python workers get small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind and hand Python workers batches of 16 MB at most."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts lineage: the table outlives any executor. The shuffle files behind it are deleted with the end of the job.
    """
    path = shared_dir(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._landmarq_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` wrote."""
    path = getattr(df, "_landmarq_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)  # noqa: SLF001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The array of words; empty for null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    """How many words; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_prefix(df: DataFrame, order: Sequence[Column], size: str | None = None, name: str = "prefix") -> DataFrame:
    """Adds ``_index`` (0-based place in the global order) and ``_before`` (the sum of ``size`` ahead of the row).

    The rows are range-partitioned and written; one total for each partition
    gives the partitions' offsets, and a window inside each partition the rest.
    No task sees more than a range of the rows, however the keys are spread;
    only the partitions' totals meet, one row each. Rows that tie on every
    ordering column stand in any order. ``order`` holds columns that sort
    ascending or descending expressions; a random column keeps ties apart.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_tie", F.rand(11))
    ranged = keyed.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    stored = materialise(ranged.withColumn("_part", F.spark_partition_id()), name)
    amount = F.col(size) if size else F.lit(0).cast("long")
    totals = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_ahead"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum_ahead"),
    )
    inside = Window.partitionBy("_part").orderBy(*order, F.col("_tie"))
    out = stored.withColumns({
        "_index": (F.row_number().over(inside) - 1).cast("long"),
        "_before": (F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - amount).cast("long"),
    })
    # One row for each shuffle partition, so the size is that setting's.
    out = out.join(F.broadcast(offsets), "_part")
    return out.withColumns({"_index": F.col("_index") + F.col("_rows_ahead"), "_before": F.col("_before") + F.col("_sum_ahead")}).drop(
        "_part", "_tie", "_rows_ahead", "_sum_ahead"
    )


def has_unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null and none comes twice; only ids are read and moved."""
    counts = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where("_id is null or _n > 1").isEmpty()


def numbered(df: DataFrame, id_col: str, number: str = "_number") -> DataFrame:
    """``df`` with a number of its own for each row, in the order of ``id_col`` (nulls last), written to the shared folder."""
    return materialise(with_prefix(df, [F.col(id_col).asc_nulls_last()], name="numbered").withColumnRenamed("_index", number).drop("_before"), "numbered")


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed so that no name can clash with an operator's own, and the new name of each."""
    names = {c: f"_given_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unshielded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``names`` only, under the names that they had."""
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))
