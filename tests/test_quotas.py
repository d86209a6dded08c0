import itertools
import math
import random

import pytest
from landmarq.operators import groups, quotas
from pyspark.sql import functions as F


def shares_of(spark, pi, sizes):
    rows = [(chr(65 + i), n, p, 1.0, p) for i, (p, n) in enumerate(zip(pi, sizes))]
    return spark.createDataFrame(rows, "grp string, n long, pi double, weight double, pi_weight double")


def kl(pi, counts, alpha=1.0):
    k, g = sum(counts), len(counts)
    return sum(p * math.log(p / ((c + alpha) / (k + alpha * g))) for p, c in zip(pi, counts) if p > 0)


def counts_of(frame):
    return [r.c for r in frame.orderBy("grp").collect()]


def test_hand_example(spark):
    assert counts_of(quotas.quota_counts(shares_of(spark, (0.5, 0.3, 0.2), (10, 10, 10)), 6)) == [3, 2, 1]


def test_least_divergence_of_all_allocations(spark):
    pi, sizes = (0.5, 0.3, 0.2), (8, 6, 4)
    for k in range(3, 12):
        got = counts_of(quotas.quota_counts(shares_of(spark, pi, sizes), k))
        best = min(kl(pi, c) for c in itertools.product(*(range(1, n + 1) for n in sizes)) if sum(c) == k)
        assert sum(got) == k and kl(pi, got) == pytest.approx(best)


def test_capacity_binds_and_floors_may_rise(spark):
    shares = shares_of(spark, (0.6, 0.4), (3, 60))
    floors = {k: kl((0.6, 0.4), counts_of(quotas.quota_counts(shares, k))) for k in (2, 4, 6, 10)}
    assert [round(floors[k], 4) for k in (2, 4, 6, 10)] == [0.0201, 0.0097, 0.0201, 0.1483]


def test_random_instances_match_a_greedy_loop(spark):
    random.seed(1)
    for _ in range(6):
        g = random.randint(2, 6)
        raw = [random.random() for _ in range(g)]
        pi, sizes = [x / sum(raw) for x in raw], [random.randint(1, 9) for _ in range(g)]
        k = random.randint(g, sum(sizes))
        counts = [1] * g
        while sum(counts) < k:
            gains = [(pi[i] * math.log((counts[i] + 2) / (counts[i] + 1)), -i) if counts[i] < sizes[i] else (-math.inf, -i) for i in range(g)]
            counts[-max(gains)[1]] += 1
        assert counts_of(quotas.quota_counts(shares_of(spark, pi, sizes), k)) == counts


def test_too_many_or_too_few(spark):
    with pytest.raises(ValueError):
        quotas.quota_counts(shares_of(spark, (0.5, 0.5), (2, 2)), 5)
    assert counts_of(quotas.quota_counts(shares_of(spark, (0.5, 0.3, 0.2), (2, 2, 2)), 2)) == [1, 1, 0]


def test_path_agrees_with_single_quotas(spark):
    shares = shares_of(spark, (0.3, 0.3, 0.2, 0.2), (50, 50, 50, 50))
    path = {(r.k, r.grp): r.c for r in quotas.quota_path(shares, [4, 10, 20, 50, 100]).collect()}
    for k in (4, 10, 20, 50, 100):
        assert [path[k, g] for g in "ABCD"] == counts_of(quotas.quota_counts(shares, k))


def test_proportional_with_full_groups(spark):
    shares = shares_of(spark, (0.6, 0.2, 0.2), (3, 10, 10))
    assert counts_of(quotas.proportional_counts(shares, 10)) == [3, 4, 3]
    assert sum(counts_of(quotas.proportional_counts(shares, 10, reassign=False))) < 10
    assert counts_of(quotas.rounded_counts(shares, 10)) == [6, 2, 2]
    assert counts_of(quotas.rounded_counts(shares_of(spark, (0.98, 0.01, 0.01), (9, 9, 9)), 3)) == [2, 0, 1]


@pytest.fixture(scope="module")
def units(spark):
    rows = [(i, "ABC"[i % 3] if i < 28 else "B", float(i) if i % 4 else None) for i in range(30)] + [(99, None, -5.0)]
    return spark.createDataFrame(rows, "unit_id long, grp string, weight double")


def test_shares_with_odd_weights(units):
    rows = {r.grp: r for r in groups.group_shares(units).collect()}
    assert sum(r.n for r in rows.values()) == 31 and sum(r.pi for r in rows.values()) == pytest.approx(1)
    assert rows[None].weight == 0 and rows[None].pi_weight == 0


def test_projection_keeps_what_fits(units):
    shares = groups.group_shares(units)
    wanted = quotas.quota_counts(shares, 9).cache()
    start = units.where("unit_id < 12").select("unit_id")
    got = quotas.project_to_quotas(units, start, wanted).collect()
    want = {r.grp: r.c for r in wanted.collect()}
    assert {g: sum(r.grp == g for r in got) for g in want} == want and len({r.unit_id for r in got}) == 9
    kept = {r.unit_id for r in got} & set(range(12))
    assert len(kept) == sum(min(want[g], sum((i % 3) == "ABC".index(g) for i in range(12))) for g in "ABC")
    assert quotas.quota_satisfaction(units, quotas.project_to_quotas(units, start, wanted), wanted).first().satisfied


def test_samples_repeat_and_are_distinct(units):
    one = [r.unit_id for r in quotas.uniform_sample(units, 7, seed=3).collect()]
    assert one == [r.unit_id for r in quotas.uniform_sample(units.repartition(5), 7, seed=3).collect()] and len(set(one)) == 7
    weighted = [r.unit_id for r in quotas.uniform_sample(units, 22, seed=3, weight="weight").collect()]
    assert not {0, 4, 8, 99} & set(weighted)
    assert quotas.project_to_size(units, units.limit(3), 10).count() == 10


def test_empty_selection(units):
    row = quotas.group_diagnostics(units, units.where("false").select("unit_id"), groups.group_shares(units)).first()
    assert (row.kl, row.l1, row.max_deviation) == (float("inf"), 2.0, 1.0)


def test_equal_weights_are_counts(units):
    flat = units.withColumn("weight", F.lit(1.0))
    chosen, shares = quotas.uniform_sample(flat, 8), groups.group_shares(flat)
    assert quotas.group_diagnostics(flat, chosen, shares).first().kl == pytest.approx(quotas.group_diagnostics(flat, chosen, shares, weight="weight").first().kl)


def test_small_groups_merge(units):
    rows = {r.grp: r["count"] for r in groups.merge_small_groups(units, 5).groupBy("grp").count().collect()}
    assert rows["OTHER"] == 1 and sum(rows.values()) == 31
