from fnmatch import fnmatch
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from landmarq.llm import training_order
from landmarq.llm._common import shared_dir

ARGS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def coder():
    return training_order._encoding(open(ARGS[0], encoding="ascii").read(), ARGS[1])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1000, 4097])
def test_permutations(n):
    slots = training_order.permute(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 50:
        assert (slots != training_order.permute(np.arange(n), n, 6)).any() and (slots != np.arange(n)).sum() > n / 2


def slow_slot(index, n, key):
    """The network on plain integers, one index at a time."""
    half = training_order.half_bits(n)
    mask, full = (1 << half) - 1, (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    while True:
        left, right = index >> half, index & mask
        for r in range(training_order.ROUNDS):
            left, right = right, left ^ mixed(right + (key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & full) & mask
        index = left << half | right
        if index < n:
            return index


@pytest.mark.parametrize("runs", [1, 3])
def test_slots_and_records_by_brute_force(spark, sf, runs):
    """Every sequence lies where the permuted index of its place in the scan says, at that byte of that shard, holding its tokens."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    path, length = shared_dir(spark, "order"), 64
    manifest = training_order.write_order(docs, path, *ARGS, key=7, length=length, shard_rows=37, runs=runs)
    want = []
    for r in docs.collect():
        ids = [*coder().encode_ordinary(r.text), 50256]
        want += [(r.doc_id, k, ids[at : at + length]) for k, at in enumerate(range(0, len(ids), length))]
    n = len(want)
    want = {slow_slot(i, n, 7): w for i, w in enumerate(want)}
    assert sorted(want) == list(range(n)) and manifest["sequences"] == n and manifest["shards"] == -(-n // 37)
    rows = training_order.read_order(spark, path, manifest).collect()
    assert {r.slot: (r.id, r.seq_no, np.frombuffer(r.ids, "<u2").tolist()) for r in rows} == want and len(rows) == n
    folder = Path(path.removeprefix("file://"))
    for r in rows[::17]:
        assert (r.shard, r.byte_offset) == (r.slot // 37, r.slot % 37 * manifest["stride"])
        (file,) = (folder / f"shards/shard={r.shard}").glob("part-*")
        assert file.stat().st_size == min(37, n - r.shard * 37) * manifest["stride"]
        assert r.ids in file.read_bytes()[r.byte_offset : r.byte_offset + manifest["stride"]]


def test_reading_goes_on_at_any_slot(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    path = shared_dir(spark, "order")
    manifest = training_order.write_order(docs, path, *ARGS, key=1, length=32, shard_rows=5)
    assert manifest["shards"] > 100
    whole = {r.slot: r for r in training_order.read_order(spark, path, manifest).collect()}
    assert sorted(whole) == list(range(manifest["sequences"]))
    for start in (0, 1, 47, 505, len(whole) // 2, len(whole) - 1, len(whole)):
        rest = training_order.read_order(spark, path, manifest, start).collect()
        assert {r.slot: r for r in rest} == {s: r for s, r in whole.items() if s >= start}


@pytest.mark.parametrize("count", [1, 9, 10, 11, 100, 1234])
def test_path_patterns_name_the_shards_from_one_on(count):
    for low in sorted({0, 1, count // 3, count // 2, count - 2, count - 1} - {-1, count}):
        patterns = training_order._from(low, count)
        found = [sum(fnmatch(f"shard={i}", p) for p in patterns) for i in range(count)]
        assert found == [0] * low + [1] * (count - low)


def test_a_damaged_shard_is_noticed(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    manifest = training_order.write_order(docs, f"file://{tmp_path}/x", *ARGS, key=1)
    (part,) = tmp_path.glob("x/shards/shard=0/part-*")
    for crc in tmp_path.glob("x/shards/shard=0/.part-*"):
        crc.unlink()
    whole = part.read_bytes()
    data = bytearray(whole)
    data[manifest["stride"] - 1] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="out of step"):
        training_order.read_order(spark, f"file://{tmp_path}/x", manifest).collect()
    part.write_bytes(whole[:-1])
    with pytest.raises(ValueError, match="shard 0 has"):
        training_order.read_order(spark, f"file://{tmp_path}/x", manifest)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = training_order.training_order(odd_docs, *ARGS, key=3, length=128).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(r.seq_no == 0 for r in rows) == odd_docs.count()
    assert training_order.training_order(no_docs, *ARGS, key=3).count() == 0
    wide = spark.createDataFrame([(None, None), (None, "a b"), (2**62, "q"), (-(2**62), "z " * 2000), (2**62, "q"), (5, "")], "doc_id long, text string")
    rows = training_order.training_order(wide, *ARGS, key=3).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and sum(r.seq_no == 0 for r in rows) == 6
    assert sorted((r.id is None, r.id or 0) for r in rows if r.seq_no == 0) == [(False, -(2**62)), (False, 5), (False, 2**62), (False, 2**62), (True, 0), (True, 0)]
