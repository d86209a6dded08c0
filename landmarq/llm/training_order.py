"""Token sequences in training order: a keyed permutation and fixed-stride shards.

Documents become token sequences of fixed length. The sequences are counted in
each part of the table and the counts summed up, so each has an index in [0, N).
A keyed Feistel network, walked until it falls inside the range, permutes [0, N):
the permuted index is the sequence's global slot. A slot alone says where its
record lies: shard ``slot // rows``, byte ``slot % rows * stride``. Shards are
ranges of slots, all of one size but the last, so reading can start or go on at
any slot and opens nothing that lies ahead of it.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ._common import discard, materialise, shared_dir, tidy

#: Tokens in a sequence.
LENGTH = 256
#: Records in a shard: at 256 tokens to a record 17 MB.
SHARD_ROWS = 1 << 15
#: The shards are written in so many runs, each of which moves only its own records: less lies on disk at a time.
RUNS = 2
#: Rounds of the Feistel network.
ROUNDS = 6
_M64 = (1 << 64) - 1
#: Slot, document id, sequence number, tokens in use, 1 if the id is null.
_HEAD = ">QqIHB"
_HEAD_BYTES = struct.calcsize(_HEAD)
#: Ends every record; a reader that is out of step notices.
_MARK = "\n"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    """Bits in each half of the least even-width block cipher over at least ``n`` values."""
    return max(1, -(-(n - 1).bit_length() // 2))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of [0, n) set by ``key``, applied to ``index``."""
    half = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & _M64) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):  # the cipher has under four times n values, so a walk is short
        x = out[walking]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[walking] = left << half | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """A worker's encoding; tasks that share a worker share it."""
    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs}, special_tokens={})


def encoded(docs: DataFrame, ranks: str, pattern: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``part, ahead, id, ids, n``: each document's tokens, how many sequences they fill and how many of its part's come before them.

    The table is written, so an index that goes by it never changes, whichever executor is lost.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(ranks)  # a rank file: about a MB

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, ahead = _encoding(shared.value, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [np.array([*coder.encode_ordinary(x.as_py()), end_id], "<u2").tobytes() for x in some.column(1)]
                counts = np.array([-(-len(x) // (2 * length)) for x in ids], np.int64)
                before = ahead + np.cumsum(counts) - counts
                ahead += int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(before), some.column(0), pa.array(ids, pa.binary()), pa.array(counts)], names=["part", "ahead", "id", "ids", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(scan, "part int, ahead long, id long, ids binary, n long"), "encoded", compression="zstd")


def write_order(
    docs: DataFrame, path: str, ranks: str, pattern: str, key: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS, end_id: int | None = None, runs: int = RUNS, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Writes ``docs`` as shards under ``path`` in the order set by ``key``; gives the manifest, which is written too.

    ``ranks`` is the path of a rank file of fewer than 65,536 tokens, ``pattern``
    its splitting pattern. Each whole text is encoded and closed by ``end_id`` (the number after the
    last rank by default); its last sequence is padded by zeros. A null text is an empty one, so
    every row has a sequence, rows that repeat an id or have none too. Ids are integers. Sequences are
    indexed in the order in which the table is scanned: the same files, read in the same
    splits, give the same order. An empty table writes no shard.

    Texts are encoded once, into a table of tokens; sums over its parts give the
    indices. Every record then moves once, in one of ``runs``, to the task that
    writes its shard. A lost task is run again from the table of tokens, and the engine's
    committer publishes whole files only.
    """
    spark = docs.sparkSession
    text = Path(ranks).read_text(encoding="ascii")
    end_id = end_id if end_id is not None else 1 + max(int(line.split()[1]) for line in text.splitlines())
    if not 0 <= end_id < 1 << 16 or length >= 1 << 16:
        raise ValueError("tokens and lengths are stored in 16 bits")
    tokens = encoded(docs, text, pattern, length, end_id, id_col, text_col)
    sums = tokens.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part of the table's scan
    offsets = materialise(sums.select(F.col("part").alias("_p"), "n", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")), "offsets")
    count = offsets.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = -(-count // shard_rows)
    stride = _HEAD_BYTES + 2 * length + len(_MARK)
    manifest = {"length": length, "stride": stride, "shard_rows": shard_rows, "shards": shards, "sequences": count, "key": key, "rounds": ROUNDS}
    indexed = tokens.join(F.broadcast(offsets.select("_p", "offset")), F.col("part") == F.col("_p")).select((F.col("ahead") + F.col("offset")).alias("first"), "id", "ids", "n")

    def records(low: int, high: int):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    first, n = part.column(0).to_numpy(), part.column(3).to_numpy()
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    slots = permute(np.repeat(first, n) + place, count, key)
                    own = np.flatnonzero((slots >= low) & (slots < high))
                    rows = np.repeat(np.arange(len(n)), n)[own]
                    ids, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                    out = []
                    for slot, row, k in zip(slots[own].tolist(), rows.tolist(), place[own].tolist()):
                        used = texts[row][2 * length * k : 2 * length * (k + 1)]
                        out.append((struct.pack(_HEAD, slot, ids[row] or 0, k, len(used) // 2, ids[row] is None) + used).ljust(stride - len(_MARK), b"\0"))
                    yield pa.RecordBatch.from_arrays([pa.array(slots[own]), pa.array(out, pa.binary())], names=["slot", "record"])

        return scan

    for run in range(runs):
        low, high = shards * run // runs, shards * (run + 1) // runs
        if low == high:
            continue
        placed = indexed.mapInArrow(records(low * shard_rows, high * shard_rows), "slot long, record binary").withColumn("shard", F.floor(F.col("slot") / F.lit(shard_rows)).cast("long"))
        tasks = max(1, min(high - low, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        ranged = placed.repartitionById(tasks, F.floor((F.col("shard") - F.lit(low)) * tasks / F.lit(high - low)).cast("int")).sortWithinPartitions("shard", "slot")  # as the writer wants it, or it would sort by shard alone
        # The mark that ends a record is the writer's line separator.
        with tidy(spark):
            ranged.select("shard", F.col("record").cast("string").alias("value")).write.mode("append").partitionBy("shard").option("lineSep", _MARK).option("compression", "none").text(f"{path}/shards")
    discard(tokens)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def _from(low: int, count: int) -> list[str]:
    """Path patterns of the shards from ``low`` to ``count - 1``: for each digit one, whatever the number of shards."""
    width = len(str(count - 1))
    text = str(low)
    out = [f"shard={text}"]
    for i in range(len(text) - 1, -1, -1):
        if text[i] < "9":
            out.append(f"shard={text[:i]}[{int(text[i]) + 1}-9]" + "[0-9]" * (len(text) - 1 - i))
    return out + [f"shard=[1-9]{'[0-9]' * (w - 1)}" for w in range(len(text) + 1, width + 1)]


def _number(field: Column) -> Column:
    """A big-endian number of at most 63 bits, or a signed one of 64."""
    return F.conv(F.hex(field), 16, -10).cast("long")


def check_shards(spark: SparkSession, path: str, manifest: dict) -> None:
    """ValueError unless each shard is one file of the size that the manifest sets; only file sizes are read."""
    rows, count, shards = manifest["shard_rows"], manifest["sequences"], manifest["shards"]
    files = spark.read.format("binaryFile").load(f"{path}/shards").select(F.col("shard").cast("long").alias("shard"), "length")
    held = files.groupBy("shard").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    size = F.least(F.lit(rows), F.lit(count) - F.col("shard") * rows) * manifest["stride"]
    bad = held.where((F.col("bytes") != size) | (F.col("files") != 1) | (F.col("shard") >= shards)).orderBy("shard").first()
    if bad:
        raise ValueError(f"shard {bad['shard']} has {bad['bytes']} bytes in {bad['files']} files")
    if held.count() != shards:
        raise ValueError("a shard is missing")


def read_order(spark: SparkSession, path: str, manifest: dict, start: int = 0) -> DataFrame:
    """``slot, shard, byte_offset, id, seq_no, ids`` of all sequences from slot ``start`` on.

    Shards ahead of ``start`` aren't opened; the others are read in ranges of
    whole records, so a task holds no shard. A shard that isn't of its size, or
    a record without its mark or outside its slots, raises.
    """
    schema = "slot long, shard long, byte_offset long, id long, seq_no long, ids binary"
    stride, rows, count = manifest["stride"], manifest["shard_rows"], manifest["sequences"]
    if start >= count:
        return spark.createDataFrame([], schema)
    check_shards(spark, path, manifest)
    folders = ",".join(f"{path}/shards/{name}/part-*" for name in _from(start // rows, manifest["shards"]) if _held(spark, f"{path}/shards/{name}"))
    context = spark._jsc.sc()  # noqa: SLF001
    # The engine's input format for records of one length: it cuts files into ranges of whole records.
    found = context.binaryRecords(folders, stride, context.hadoopConfiguration())
    raw = DataFrame(spark._jsparkSession.createDataset(found, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("r")  # noqa: SLF001
    field = lambda at, size: F.substring("r", at + 1, size)
    out = raw.withColumn("slot", _number(field(0, 8)))
    whole = (field(stride - len(_MARK), len(_MARK)) == F.lit(_MARK.encode())) & F.col("slot").between(0, count - 1)
    out = out.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a record is out of step: slot "), F.coalesce(F.col("slot").cast("string"), F.lit("?"))))))
    return out.where(F.col("slot") >= start).select(
        "slot", F.floor(F.col("slot") / F.lit(rows)).cast("long").alias("shard"), ((F.col("slot") % rows) * stride).cast("long").alias("byte_offset"),
        F.when(_number(field(22, 1)) == 0, _number(field(8, 8))).alias("id"), _number(field(16, 4)).alias("seq_no"),
        F.substring(F.col("r"), F.lit(_HEAD_BYTES + 1), (_number(field(20, 2)) * 2).cast("int")).alias("ids"),
    )


def _held(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)  # noqa: SLF001
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)  # noqa: SLF001
    return found is not None and len(found) > 0


def training_order(docs: DataFrame, ranks: str, pattern: str, key: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards to the shared folder and reads them back (``read_order``)."""
    path = shared_dir(docs.sparkSession, "training-order")
    manifest = write_order(docs, path, ranks, pattern, key, length, shard_rows, id_col=id_col, text_col=text_col)
    return read_order(docs.sparkSession, path, manifest)
