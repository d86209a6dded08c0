import gzip
import hashlib

import pytest
from landmarq.llm import warc
from landmarq.llm._common import shared_dir
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"
ODD = [
    (9001, None, None), (9002, "u", ""), (9003, "x\r\ny", "é\r\n\r\nWARC/1.1\r\n" * 3000), (None, None, "z" * 5000), (9004, "q", "z" * 5000), (9005, "q", "z" * 999), (9006, "q", "z" * 999),
    (9007, "q", "0\r\n\r\n" * 400), (9007, "q", "other"), (9008, "q", "z" * 5000),
]


def slow(rows):
    """(id, digest) to (bytes, type, refers to)."""
    by = {}
    for i, h in rows:
        by.setdefault(h, []).append(i)
    out = {}
    for i, h in rows:
        data = (h or "").encode()
        last = max((x for x in by[h] if x is not None), default=None)
        again = len(data) >= 1000 and len(by[h]) > 1 and i != last
        out[i, hashlib.sha1(data).hexdigest()] = (len(data), "revisit" if again else "response", last if again else None)
    return out


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    copies = pages.limit(30).withColumn("page_id", F.col("page_id") + 100000)
    odd = spark.createDataFrame(ODD, SCHEMA)
    everything = pages.union(copies).union(odd).union(odd).withColumn("type", F.lit("clash")).withColumn("_digest", F.lit("clash"))
    got = warc.archive_pages(everything, segment_bytes=1500).collect()
    want = slow({(r.page_id, r.html) for r in everything.collect()})
    assert len(got) == everything.count() > len(want)
    assert {(r.page_id, r.payload_digest): (r.payload_bytes, r.record_type, r.refers_to) for r in got} == want
    assert max(r.segments for r in got) > 20 and not any(r.error for r in got)


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_framing():
    for size in (0, 1, 7, 4096, 10000):
        data = bytes(range(256)) * (size // 256 + 1)
        assert warc.unframe(warc.frame(data[:size], 1000)) == data[:size]
    assert warc.unframe(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc", b"3\r\nabcde\r\n0\r\n\r\n", b"zz\r\n", b"1\r\nA\r\n-6\r\n0\r\n\r\n", b"-2\r\n\r\n", b"+1\r\nA\r\n0\r\n\r\n", b"0x1\r\nA\r\n0\r\n\r\n", b"1_0\r\n", b"\r\n", b""):
        with pytest.raises(ValueError):
            warc.unframe(broken)


def archive(tmp_path, records, members=True):
    blobs = [r + b"\r\n\r\n" for r in records]
    data = b"".join(map(gzip.compress, blobs)) if members else b"".join(blobs)
    (tmp_path / "part-0.warc").write_bytes(data)
    return f"file://{tmp_path}"


def segments(key="k:00", payload=b"p" * 4000, size=1000):
    return list(warc._records(key, "http://x", payload, None, size))


@pytest.mark.parametrize("members", [True, False])
def test_segments_in_any_order(spark, tmp_path, members):
    parts = segments()
    rows = warc.read_archives(spark, archive(tmp_path, [parts[3], parts[1], *parts[::-1]], members)).collect()
    assert [(r.segments, r.payload, r.error) for r in rows] == [(5, b"p" * 4000, None)]


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda p: p[:1] + p[2:], "a segment is missing"), (lambda p: p[:-1], "its last segment is missing"), (lambda p: p[1:], "its first segment is missing"),
        (lambda p: [*p[:-1], p[-1].replace(b"Total-Length: 4", b"Total-Length: 5")], "4099 of 5099 bytes"), (lambda p: [p[0].replace(b"ppp", b"pqp", 1), *p[1:]], "block digest differs"),
    ],
)
def test_broken_segments_are_told(spark, tmp_path, change, error):
    parts = segments()
    rows = warc.read_archives(spark, archive(tmp_path, change(parts))).collect()
    assert [(r.payload, r.error) for r in rows] == [(None, error)]


def test_many_small_files(spark, sf):
    """Files are closed at a set number of records; continuation records then lie in other files than their origin."""
    path = shared_dir(spark, "warc")
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(40)
    warc.write_archives(pages, path, segment_bytes=700, records_per_file=3)
    rows = warc.read_archives(spark, path).collect()
    assert {r.payload.decode() for r in rows if r.type == "response"} == {r.html for r in pages.collect()}


HEAD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\n"


@pytest.mark.parametrize(
    ("bad", "error"),
    [
        (HEAD + b"\r\n", "bad Content-Length"), (HEAD + b"Content-Length: -5\r\n\r\nabc", "bad Content-Length"), (HEAD + b"Content-Length: +3\r\n\r\nabc", "bad Content-Length"),
        (HEAD + b"Content-Length: 1_0\r\n\r\nabc", "bad Content-Length"), (HEAD + b"Content-Length: 999\r\n\r\nabc", "a block is cut off"), (b"junk\r\n\r\n", "not a WARC record"), (HEAD[:30], "bad Content-Length"),
    ],
)
def test_a_damaged_file_gives_one_error_row(spark, tmp_path, bad, error):
    good = segments("k:00", b"p" * 100, 1000)
    (tmp_path / "part-1.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in segments("k:01", b"q" * 50, 1000)))
    rows = warc.read_archives(spark, archive(tmp_path, [*good, bad], members=False)).collect()
    assert sorted((r.payload or b"", r.error) for r in rows) == [(b"", error), (b"p" * 100, None), (b"q" * 50, None)]
    assert [r.type for r in rows if r.error] == ["broken"] and all(r.uri.endswith("part-0.warc") for r in rows if r.error)


def test_a_cut_head():
    with pytest.raises(ValueError, match="head is cut off"):
        list(warc.parse_records(HEAD[:30]))


def test_cut_gzip_and_bad_segment_numbers(spark, tmp_path):
    whole = gzip.compress(segments("k:00", b"p" * 100, 1000)[0] + b"\r\n\r\n")
    (tmp_path / "part-0.warc").write_bytes(whole + whole[:-12])
    (tmp_path / "part-1.warc").write_bytes(whole[:20] + b"\xff" * 30 + whole[50:])
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sum(r.payload == b"p" * 100 for r in rows) in (1, 2) and sum(r.type == "broken" for r in rows) == 2
    other = tmp_path / "x"
    other.mkdir()
    bad = [HEAD + b"WARC-Segment-Number: -1\r\nContent-Length: 3\r\n\r\nabc", *segments("k:02", b"r" * 9, 1000)]
    rows = warc.read_archives(spark, archive(other, bad, members=False)).collect()
    assert sorted((r.type, r.payload, r.error) for r in rows) == [("broken", None, "bad segment number"), ("response", b"r" * 9, None)]


def test_odd_ids(spark):
    rows = [("a:b\r\nc", None, "t" * 2000), (None, None, "t" * 2000), ("~", None, "t" * 2000), ("", None, "u"), ("é>", None, "t" * 2000)] * 2
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r.page_id or "-", r.record_type, r.refers_to) for r in got) == sorted([("-", "response", None), ("-", "revisit", "é>"), ("a:b\r\nc", "revisit", "é>"), ("~", "revisit", "é>"), ("é>", "response", None)] * 2)


def test_whole_records_are_finished_in_the_worker_that_reads_them(spark, tmp_path):
    """One Python worker a task, not one that reads and another that verifies: blocks don't go to the JVM and back."""
    read = warc.read_archives(spark, archive(tmp_path, segments(size=10000)))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # whole records; segments as they are read and as they meet
    info = HEAD.replace(b"response", b"warcinfo") + b"Content-Length: 3\r\n\r\nabc"
    records = [info, *segments("k:01", b"q" * 50, 1000), *segments(size=1000), info]
    rows = warc.read_archives(spark, archive(tmp_path, records)).collect()
    assert sorted((r.record_id, r.payload, r.segments, r.error) for r in rows) == [("<urn:landmarq:k:00>", b"p" * 4000, 5, None), ("<urn:landmarq:k:01>", b"q" * 50, 1, None)]


def test_python_workers_get_batches_of_few_bytes(spark, tmp_path, monkeypatch):
    """Ten thousand pages of a batch may be long ones; what a worker holds is bounded by bytes while archives are written."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, write = spark.conf.get(name), DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (seen.append(spark.conf.get(name)), write(self, *a, **k))[1])
    pages = spark.createDataFrame([(i, None, f"{i} " * 4000) for i in range(20)], SCHEMA)
    warc.write_archives(pages, f"file://{tmp_path}/out")
    assert seen == ["16m"] and spark.conf.get(name) == before
    assert {r.payload.decode() for r in warc.read_archives(spark, f"file://{tmp_path}/out").collect()} == {f"{i} " * 4000 for i in range(20)}


def test_responses_do_not_meet_in_one_task(spark):
    """No revisits, so nothing has to be joined; a null key would bring all rows to one partition."""
    pages = spark.createDataFrame([(i, None, f"{i} " * 300) for i in range(200)], SCHEMA)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "8")):
            spark.conf.set(k, v)
        got = warc.archive_pages(pages).select("page_id", "payload_bytes", "record_type", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(i, len(f"{i} ") * 300, "response") for i in range(200)]
    assert len({r.part for r in got}) > 1
