"""Contiguous balanced shards from a global prefix sum of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, with_prefix

#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32`` for each row; a null text counts as no bytes."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def byte_shards(sized: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with a ``size``.

    Rows go in the order of ``id_col`` (nulls first). Byte prefix sums come
    from a range partitioning, the partitions' totals and a running sum inside
    each; the whole is cut at equal targets, and a row belongs to the shard in
    which its middle byte lies. So a shard differs from its equal share by half
    a row at either end. ``slot`` counts a shard's rows from 0 without gaps.
    Rows that tie on the id stand in order of size and checksum; equal rows are
    interchangeable. Fewer rows than shards leave shards empty; an empty table
    gives an empty table. Sizes must be positive.
    """
    order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = materialise(with_prefix(sized, order, "size"), "prefix")
    total = placed.agg(F.max(F.col("_before") + F.col("size")).alias("total")).first()["total"] or 1
    middle = (F.col("_before") * 2 + F.col("size")).cast("decimal(38,0)") * F.lit(shards)
    cut = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total)).cast("int"), F.lit(shards - 1)))
    starts = cut.groupBy("shard").agg(F.min("_index").alias("_start"))  # a row for each shard
    return cut.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_index") - F.col("_start")).drop("_index", "_before", "_start")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` of every row of ``docs``; other columns are ignored."""
    return byte_shards(materialise(sizes(docs, id_col, text_col), "sizes"), shards, id_col)
