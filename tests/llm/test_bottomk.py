import hashlib

import pytest
from landmarq.llm import bottomk
from pyspark.sql import functions as F


def shingles(text, size=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts(rows):
    """(id, text) rows in descending order with their edited texts and next texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    following = rows[1:] + rows[:1]
    return [(i, t, t[: len(t) - len(t) // 3] + n[: len(t) // 3], n) for (i, t), (_, n) in zip(rows, following)]


@pytest.mark.parametrize("partitions", ["4", "1"])
def test_edits_and_estimates(spark, sf, partitions):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in bottomk.edit_pairs(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == docs.count()
    for i, text, edited, following in edited_texts(docs.select("doc_id", "text").collect()):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        assert r.near_edited == pytest.approx(alike(a, b), abs=0.2)
        assert r.near_next == pytest.approx(alike(a, shingles(following)), abs=0.2)
        assert r.distinct_shingles == pytest.approx(len(a), rel=0 if len(a) < bottomk.K else 0.4)
        if len(a | b) < bottomk.K:
            assert r.near_edited == pytest.approx(alike(a, b))


def test_odd_rows(odd_docs, no_docs):
    rows = bottomk.edit_pairs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert r.n_chars == len(texts[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_text[""] == "" and {r.near_edited for r in rows if r.doc_id in (1, 2)} == {1.0}
    want = sorted(hashlib.sha256(e.encode()).hexdigest() for _, _, e, _ in edited_texts((r.doc_id, r.text) for r in odd_docs.collect()))
    assert sorted(r.edited_sha256 for r in rows) == want
    assert bottomk.edit_pairs(no_docs).count() == 0
    alone = bottomk.edit_pairs(odd_docs.where("doc_id = 6")).collect()
    assert [(r.near_next, r.edited_sha256) for r in alone] == [(1.0, hashlib.sha256(b"ono").hexdigest())]


def test_null_ids_come_last(spark):
    docs = spark.createDataFrame([(None, "aaa"), (5, "bbbccc"), (-3, "dddeee")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in bottomk.edit_pairs(docs).collect()}
    assert got == {k: hashlib.sha256(v).hexdigest() for k, v in {5: b"bbbcdd", -3: b"dddeaa", None: b"aab"}.items()}


SPREADS = {
    "one far id": [*range(4000), 2**60], "strings": [f"id-{i * i % 5003:05d}x" for i in range(2500)], "one id holds most": [7] * 1500 + list(range(100, 900)), "no ids": [None] * 2000 + [1, 2],
    "negative": [-(3**i) for i in range(30)] + list(range(1000)),
}


@pytest.mark.parametrize("spread", SPREADS)
def test_stretches_are_even_however_ids_are_spread(spark, spread):
    ids = SPREADS[spread]
    kind = "string" if isinstance(ids[0], str) else "long"
    docs = spark.createDataFrame([(i, f"t{n:05d}") for n, i in enumerate(ids)], f"doc_id {kind}, text string").repartition(3)
    got = bottomk.with_next(docs, ["text"])
    rows = sorted(ids_texts := [(i, f"t{n:05d}") for n, i in enumerate(ids)], key=lambda r: r[1])
    present = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in rows if r[0] is None]
    assert {r.text: r.next_text for r in got.collect()} == {a[1]: b[1] for a, b in zip(present, present[1:] + present[:1])}
    assert got.count() == len(ids_texts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = bottomk.with_next(docs, ["text"]).groupBy(F.spark_partition_id()).agg(F.max("next_text"), F.count(F.lit(1)).alias("count")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in tasks) < 0.7 * len(ids)


def test_cuts_find_every_place(spark):
    """The look-up in blocks gives what counting all cuts gives."""
    cuts = sorted({(i * 7919) % 100_003 for i in range(700)}, reverse=True)
    frame = spark.createDataFrame([(i,) for i in [*range(0, 100_003, 37), *cuts[:40], -5, 2**40]], "k long")
    at, leads = bottomk._stretch(F.col("k"), "bigint", cuts)
    for r in frame.select("k", at.alias("at"), leads.alias("leads")).collect():
        assert (r["at"], r.leads) == (sum(c >= r.k for c in cuts), r.k in cuts)


def test_sketches_merge(spark):
    """A sketch of a whole is the merge of its parts' sketches, by columns and by groups."""
    frame = spark.createDataFrame([(k, i, [hash((k, i, j)) for j in range(300)]) for k in (1, 2, None) for i in range(4)], "k int, i int, h array<long>")
    parts = frame.withColumn("sketch", F.slice(F.sort_array("h"), 1, 50)).withColumn("_hash", F.lit(0))
    merged = {r.k: r.sketch for r in bottomk.merge_groups(parts, ["k"], k=50).collect()}
    want = {}
    for r in frame.collect():
        want.setdefault(r.k, []).extend(r.h)
    assert merged == {k: sorted(v)[:50] for k, v in want.items()}
    pair = spark.createDataFrame([(sorted(want[1])[:50], sorted(want[2])[:50])], "a array<long>, b array<long>").select(bottomk.merge(F.col("a"), F.col("b"), 50).alias("m")).first()
    assert pair.m == sorted(want[1] + want[2])[:50]


def test_containment(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(1000)))], "a string, b string")
    both = bottomk.with_sketch(bottomk.with_sketch(docs, "a", "sa"), "b", "sb")
    r = both.select(bottomk.containment(F.col("sb"), F.col("sa")).alias("inside"), bottomk.containment(F.col("sa"), F.col("sb")).alias("outside")).first()
    assert r.inside == pytest.approx(1, abs=0.2) and r.outside == pytest.approx(0.5, abs=0.15)


def test_plan_has_no_python(odd_docs):
    plan = bottomk.edit_pairs(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
