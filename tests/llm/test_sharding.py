import zlib

from landmarq.llm import sharding


def test_contiguous_balanced_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    rows = sorted(sharding.shard_documents(docs, 40).collect(), key=lambda r: r.doc_id)
    total, before, slots = sum(len(t) + 16 for t in texts.values()), 0, {}
    for r in rows:
        data = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert r.shard == min(39, (2 * before + r.size) * 40 // (2 * total))
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        before += r.size
    assert len(rows) == len(texts)


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows if r.doc_id == 1} == {16}
    assert sharding.shard_documents(no_docs, 4).count() == 0
    assert sharding.shard_documents(odd_docs.limit(1), 40).count() == 1
