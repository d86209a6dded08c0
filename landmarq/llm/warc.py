"""WARC archives: writing records and putting segmented records together again.

``write_archives`` stores payloads as HTTP responses in chunked transfer
framing. A block longer than a segment is split: the first segment is the
response record, the rest are continuation records that name it as their
origin. ``read_archives`` scans archives whole, groups continuation records by
origin identifier, orders them by segment number, verifies the total length and
digests, and decodes the transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import materialise, remove, shared_dir, tidy

#: Bytes of a record's block before it is split.
SEGMENT_BYTES = 16 * 1024
#: Bytes in a chunk of the transfer framing.
CHUNK_BYTES = 4096
#: Records in an archive file: with segments this bounds a file at 64 MB before compression.
RECORDS_PER_FILE = 4096
#: Least payload for which a revisit record is worth its header.
LEAST_REVISIT = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"
_HEX, _DIGITS = re.compile(rb"[0-9A-Fa-f]{1,15}"), re.compile(r"[0-9]{1,15}")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = bytearray()
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += b"%x\r\n" % len(part) + part + _CRLF
    return bytes(out + b"0\r\n\r\n")


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken. A chunk's size is hexadecimal digits alone, without a sign."""
    out, at = bytearray(), 0
    while True:
        end = body.index(_CRLF, at)
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not _HEX.fullmatch(digits):
            raise ValueError("no chunk size")
        size = int(digits, 16)
        at = end + 2
        if not size:
            if body[at:].strip() and b":" not in body[at:]:
                raise ValueError("no trailer")
            return bytes(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != _CRLF:
            raise ValueError("a chunk is cut off")
        out += body[at : at + size]
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def whole_number(text: str | None, what: str) -> int | None:
    """The number that ASCII digits alone write; None for None, ValueError for anything else."""
    if text is None:
        return None
    if not _DIGITS.fullmatch(text):
        raise ValueError(f"bad {what}")
    return int(text)


def _clean(text: str) -> str:
    return "".join(c for c in text if c.isprintable())


def _records(key: str, url: str | None, payload: bytes, refers: str | None, segment_bytes: int) -> Iterator[bytes]:
    """All records of one row; ``key`` becomes its record identifier."""
    own = f"<urn:landmarq:{key}>"
    digest = "sha1:" + _base32(hashlib.sha1(payload).digest())
    target = [("WARC-Target-URI", _clean(url))] if url else []
    common = [("WARC-Date", _DATE), *target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:landmarq:{refers}>")], http)
        return
    block = http + frame(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Block-Digest", "sha1:" + _base32(hashlib.sha1(block).digest()))]
    yield _record(first + [("WARC-Segment-Number", "1")] * (len(parts) > 1), parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:landmarq:{key}:{i}>"), ("WARC-Date", _DATE), *target, ("WARC-Segment-Number", str(i)), ("WARC-Segment-Origin-ID", own), *last], part)


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``_id, _digest, _bytes, _rows, _response``, one row for each id and payload: the id whose record holds the payload.

    Of rows with equal payloads of ``least`` bytes or more the largest id is
    the response; the others revisit it. ``_rows`` says how many rows of ``pages`` share the id
    and the payload. Here only ids and digests move, no payloads; one group of
    copies combines ahead of the shuffle, and the join back is split by the
    engine where one digest holds many rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    narrow = pages.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"))
    rows = materialise(narrow.groupBy("_id", "_digest", "_bytes").agg(F.count(F.lit(1)).alias("_rows")), "digests")
    shared = rows.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.max("_id").alias("_response"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(shared.select("_digest", "_response"), "_digest", "left").select("_id", "_digest", "_bytes", "_rows", "_response")


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Writes gzipped archives under ``path`` with a record (or its segments) for each row of ``pages``.

    Payloads are UTF-8 texts or binaries; a null payload is empty, a null URL
    is left out, a null id is written as ``~``. A record is named by its row's id (URL-encoded) and
    the payload's digest; rows that repeat both have the writing task and a
    running number besides, and a revisit of such a response names it without them. The engine's own text writer
    stores the records, so ``path`` may be in any store that it reaches; a lost
    task is written again. Payloads move once, to meet the plan by id and digest;
    that shuffle's files go once the archives are written.
    """
    ship(pages.sparkSession)
    plan = plan_records(pages, id_col, payload_col)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("_page"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")).withColumn("_sha", F.sha1("_payload"))
    joined = rows.join(plan, F.col("_page").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest")))
    ident = lambda i, d: F.concat_ws(":", F.coalesce(F.url_encode(i.cast("string")), F.lit("~")), d)
    ready = joined.select(
        F.concat(ident(F.col("_id"), F.col("_digest")), F.when(F.col("_rows") > 1, F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).otherwise("")).alias("key"), "_url", "_payload",
        F.when(F.col("_response").isNotNull() & ~F.col("_response").eqNullSafe(F.col("_id")), ident(F.col("_response"), F.col("_digest"))).alias("refers"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for key, url, data, refers in zip(*(c for c in batch.columns)):
                for record in _records(key.as_py(), url.as_py(), data.as_py(), refers.as_py(), segment_bytes):
                    held.append(record)
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    records = ready.mapInArrow(scan, "value binary").select(F.col("value").cast("string"))
    # The two line ends that close a record are the writer's line separator.
    with tidy(pages.sparkSession):
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Members:
    """Bytes of a gzip file of one or more members, a part at a time; plain bytes pass through."""

    def __init__(self, data: bytes):
        self.data, self.at, self.gzip = data, 0, data[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.gzip else None

    def read(self, size: int = 1 << 20) -> bytes:
        if not self.gzip:
            part = self.data[self.at : self.at + size]
            self.at += len(part)
            return part
        while True:
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                if self.at >= len(self.data):
                    return b""
                self.inflate = zlib.decompressobj(31)
            fed = self.inflate.unconsumed_tail
            if not fed:
                fed = self.data[self.at : self.at + (1 << 18)]
                self.at += len(fed)
                if not fed:
                    raise ValueError("a gzip member is cut off")
            try:
                out = self.inflate.decompress(fed, size)
            except zlib.error as wrong:
                raise ValueError(f"gzip: {wrong}") from wrong
            if out:
                return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one archive file; ValueError on broken ones."""
    source, held = _Members(data), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            part = source.read()
            if not part:
                return False
            held.extend(part)
        return True

    while True:
        while True:  # line ends between records
            if not fill(2):
                if bytes(held).strip():
                    raise ValueError("cut off")
                return
            if held[:2] != _CRLF:
                break
            del held[:2]
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("a record's head is cut off")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        name = ""
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and name:
                headers[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        length = whole_number(headers.get("content-length", ""), "Content-Length")
        if not fill(end + 4 + length):
            raise ValueError("a block is cut off")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]


_FIELDS = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("refers", pa.string()),
    ("payload_digest", pa.string()), ("block_digest", pa.string()), ("block", pa.binary()), ("error", pa.string()),
])
_FIELDS_SQL = "record_id string, type string, uri string, segment int, origin string, total long, refers string, payload_digest string, block_digest string, block binary, error string"


def _fields(h: dict[str, str], block: bytes) -> tuple:
    """A row of ``_FIELDS``; a record whose numbers are no numbers is of type ``broken``."""
    kind, own = h.get("warc-type"), h.get("warc-record-id")
    try:
        number, total = whole_number(h.get("warc-segment-number"), "segment number"), whole_number(h.get("warc-segment-total-length"), "total length")
        if number is not None and number >= 1 << 31:
            raise ValueError("bad segment number")
    except ValueError as wrong:
        return own, "broken", h.get("warc-target-uri"), None, own, None, None, None, None, None, str(wrong)
    origin = h.get("warc-segment-origin-id") if kind == "continuation" else own
    return own, kind, h.get("warc-target-uri"), number, origin, total, h.get("warc-refers-to"), h.get("warc-payload-digest"), h.get("warc-block-digest"), block, None


_OUT = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("segments", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])
_OUT_SQL = "record_id string, type string, uri string, refers string, segments int, payload binary, error string"


#: Types of records that are read; others (warcinfo and so on) are left out.
_KNOWN = ("response", "revisit", "continuation", "broken")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _finish(rows: list[tuple]) -> tuple:
    """One logical record of its segments (rows of ``_FIELDS``), ordered by number."""
    record_id, kind, uri, number, _, _, refers, payload_digest, block_digest, _, error = rows[0]
    count = len(rows)
    if kind == "broken":
        return record_id, kind, uri, None, count, None, error
    fail = lambda why: (record_id or rows[0][4], kind, uri, refers, count, None, why)
    if kind == "continuation":
        return (rows[0][4], kind, uri, None, count, None, "its first segment is missing")
    if kind == "revisit":
        return record_id, kind, uri, refers, count, None, None
    block = b"".join(r[9] for r in rows)
    if number is not None:
        if [r[3] for r in rows] != list(range(1, count + 1)):
            return fail("a segment is missing")
        if rows[-1][5] is None:
            return fail("its last segment is missing")
        if rows[-1][5] != len(block):
            return fail(f"{len(block)} of {rows[-1][5]} bytes")
    if block_digest and block_digest != "sha1:" + _base32(hashlib.sha1(block).digest()):
        return fail("block digest differs")
    head, _, body = block.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" in head.lower():
        try:
            body = unframe(body)
        except ValueError as wrong:
            return fail(f"transfer framing: {wrong}")
    if payload_digest and payload_digest != "sha1:" + _base32(hashlib.sha1(body).digest()):
        return fail("payload digest differs")
    return record_id, kind, uri, refers, count, body, None


def _scan(spark: SparkSession, path: str, split: bool | None, finish: bool = False) -> DataFrame:
    """``scan_records``; with ``finish`` whole records of known types as rows of ``_OUT``, so that no block leaves the worker that reads it but as a payload."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    schema, held_in = (_OUT, 5) if finish else (_FIELDS, 9)

    def rows_of(name: str, data: bytes) -> Iterator[tuple]:
        try:
            for headers, block in parse_records(data):
                row = _fields(headers, block)
                if split is None or split == (row[1] == "continuation" or row[3] is not None):
                    yield row
        except ValueError as wrong:
            if not split:
                yield None, "broken", name, None, None, None, None, None, None, None, str(wrong)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in rows_of(name.as_py(), content.as_py()):
                    if finish and row[1] not in _KNOWN:
                        continue
                    held.append(_finish([row]) if finish else row)
                    size += len(held[-1][held_in] or b"")
                    if size > 8 << 20 or len(held) == 4096:
                        yield _batch(held, schema)
                        held, size = [], 0
                if held:
                    yield _batch(held, schema)

    return files.mapInArrow(scan, _OUT_SQL if finish else _FIELDS_SQL)


def scan_records(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """Every record of the archives under ``path`` as a row; a file is unpacked a part at a time.

    ``split`` keeps only segments (true) or only whole records (false). Where a file is damaged its
    records up to that place come back and then one of type ``broken`` with
    the file as ``uri`` and the reason in ``error``; a record with a bad number is ``broken`` too, and reading goes on.
    """
    return _scan(spark, path, split)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, type, uri, refers, segments, payload, error`` for each logical record under ``path``.

    Whole records are finished in the worker that reads them; only those in segments
    move, grouped by origin and sorted by segment number, and a task holds one
    record's segments at a time. A segment that repeats counts once. A record
    with a missing segment, a wrong total length, broken framing or a digest
    that differs comes back with null ``payload`` and the reason in ``error``; so does a damaged
    file or record (type ``broken``, see ``scan_records``).
    Records of other types (warcinfo and so on) are left out. An empty folder
    of archives gives an empty table.
    """
    # The archives are scanned once for whole records and once for segments: blocks are not stored a second time.
    whole, parts = _scan(spark, path, False, finish=True), scan_records(spark, path, True).where(F.col("type").isin(*_KNOWN))

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    value = tuple(row.values())
                    if held and value[4] != held[0][4]:
                        done.append(_finish(held))
                        held = []
                    if not held or value[3] != held[-1][3]:
                        held.append(value)
                if done:
                    yield _batch(done, _OUT)
                    done = []
        if held:
            yield _batch([_finish(held)], _OUT)

    together = parts.repartition("origin").sortWithinPartitions("origin", F.col("segment").asc_nulls_last(), F.col("type").desc())
    return whole.union(together.mapInArrow(many, _OUT_SQL))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back and removes them: ``id, payload_bytes, payload_digest, record_type, refers_to, segments, error``.

    Lengths and digests are those of the payload read back, for a revisit those
    of the response that it refers to. Every row of ``pages`` comes back as a row, those that repeat another too.
    An empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, segment_bytes)
    back = read_archives(spark, path)
    kind = pages.schema[id_col].dataType.simpleString()
    page_of = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, "^<urn:landmarq:([^:]*):[0-9a-f]*(?:#[0-9]*)?>$", 1), F.lit("~"))).cast(kind)
    found = materialise(back.select("record_id", "type", "refers", "segments", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"), "error"), "read-back")
    remove(spark, path)
    # Rows that repeat a response hold one payload: any of them answers for it.
    held = found.where("type = 'response'").select(F.regexp_replace("record_id", "#[0-9]*>$", ">").alias("_of"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest")).groupBy("_of").agg(
        F.max("_bytes").alias("_bytes"), F.max("_digest").alias("_digest")
    )
    # Only revisits meet their responses: the rest has no key to meet by and would land in one task.
    again = F.col("type").eqNullSafe("revisit")
    joined = found.where(again).join(held, F.col("refers") == F.col("_of"), "left").drop("_of")
    rest = found.where(~again).withColumns({"_bytes": F.lit(None).cast("long"), "_digest": F.lit(None).cast("string")})
    return joined.union(rest).select(
        page_of(F.col("record_id")).alias(id_col), F.coalesce("bytes", "_bytes").alias("payload_bytes"), F.coalesce("digest", "_digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", page_of(F.col("refers"))).alias("refers_to"), "segments", "error",
    )
