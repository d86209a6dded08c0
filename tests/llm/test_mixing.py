import re

import pytest
from landmarq.llm import mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        each = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if each[s] > most * sizes[s]]
        if not over:
            return capped | each
        capped |= {s: most * sizes[s] for s in over}


def check(rows, texts):
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(rb"[^\x20\x09-\x0D]+", (texts[r.doc_id] or "").encode()))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = slow_targets(sizes)
    for source, target in want.items():
        own = [r for r in rows if r.source == source]
        assert all(r.source_size == sizes[source] and r.target == pytest.approx(target) for r in own)
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - target) <= 0.01 * target + max([r.size for r in own if r.size] + [0]) / 2 + 1
        assert all(0 <= r.copies <= 2 for r in own)
    return want


def test_targets_and_rounding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    first = mixing.mix(docs).collect()
    assert len(first) == len(texts)
    check(first, texts)
    again = mixing.mix(docs.repartition(3)).collect()
    assert {(r.doc_id, r.copies) for r in first} == {(r.doc_id, r.copies) for r in again}


def test_rates_are_exponential_in_size(spark, sf):
    """Below the cap, log rates of one source are proportional to sizes, and expected words meet the target."""
    import math

    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        if own[0].target >= 2 * own[0].source_size:
            assert all(r.rate == 2 for r in own)
            continue
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-6)
        tilts = [math.log(r.rate) / r.size for r in own if r.size and r.rate < 2]
        assert max(tilts) == pytest.approx(min(tilts), abs=1e-9)


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, {r.doc_id: r.text for r in odd_docs.collect()})
    assert {r.copies for r in rows if r.size == 0} == {1}
    assert mixing.mix(no_docs).count() == 0
    taken = mixing.take_mix(odd_docs)
    assert taken.columns == odd_docs.columns
    assert taken.where("doc_id = 8").count() == next(r.copies for r in rows if r.doc_id == 8)


def test_repeated_and_null_ids_meet_the_target(spark):
    """Every row counts for itself, so the words taken come near each source's target though ids repeat."""
    rows = [(7, "w " * (3 + i % 5), "a") for i in range(60)] + [(None, "v " * (2 + i % 3), "b") for i in range(40)] + [(100 + i, "u " * 4, "c") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    taken = {s: 0 for s in sizes}
    for r in mixing.take_mix(docs).collect():
        taken[r.source] += len(r.text.split())
    for source, target in slow_targets(sizes).items():
        assert abs(taken[source] - target) <= 4


def test_a_hot_class_is_ranked_in_parts(spark):
    """A third of the rows are equal documents of one source."""
    rows = [(i, "same words here", "hot") for i in range(400)] + [(1000 + i, "w " * (i + 1), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(docs).collect(), {i: t for i, t, _ in rows})


@pytest.mark.parametrize("wanted", [0.03, 0.3, 1.9])
def test_one_very_long_text_does_not_hide_the_root(spark, wanted):
    classes = spark.createDataFrame([("a", 200, 20_000), ("a", 1_000_000, 1)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 5_000_000, wanted * 5_000_000)], "source string, source_size long, target double")
    taken = sum(r.n * r.rate * r["size"] for r in mixing.solve_rates(classes, targets).collect())
    assert taken == pytest.approx(wanted * 5_000_000, rel=1e-8)


def test_a_missed_target_raises(spark):
    classes = spark.createDataFrame([("a", 200, 20_000), ("a", 1_000_000, 1)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 5_000_000, 150_000.0)], "source string, source_size long, target double")
    with pytest.raises(ValueError, match="miss their targets"):
        mixing.solve_rates(classes, targets, steps=2)
