import numpy as np
import pytest
from landmarq.operators import comparison, metrics


@pytest.fixture(scope="module")
def predictions(spark):
    random = np.random.default_rng(0)
    rows = [(f"t{i % 2}", i % 4, float(y := random.normal()), float(y + 0.3 * random.normal())) for i in range(500)] + [("t0", 9, 1.0, 2.0)]
    return spark.createDataFrame(rows, "target string, grp int, y_true double, y_pred double")


def test_regression(predictions):
    table = predictions.toPandas()
    for r in metrics.regression_metrics(predictions, ["target"]).collect():
        own = table[table.target == r.target]
        e = own.y_true - own.y_pred
        assert (r.rmse, r.mae) == pytest.approx((np.sqrt((e**2).mean()), e.abs().mean()))
        assert r.r2 == pytest.approx(1 - (e**2).sum() / ((own.y_true - own.y_true.mean()) ** 2).sum())
    tails = metrics.tail_errors(predictions).first()
    error = (table.y_true - table.y_pred).abs()
    assert [tails.p90, tails.p95, tails.p99, tails.max] == pytest.approx([*np.quantile(error, [0.9, 0.95, 0.99]), error.max()])
    assert {r.grp for r in metrics.group_metrics(predictions).collect()} == {0, 1, 2, 3}


def test_constant_truth(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y_true double, y_pred double")
    assert metrics.regression_metrics(rows).first().r2 == 0.0


@pytest.mark.parametrize(("true", "pred", "accuracy", "kappa"), [("0101", "0000", 0.5, 0.0), ("0011", "0011", 1.0, 1.0), ("0000", "0000", 1.0, 0.0), ("0011", "1100", 0.0, -1.0)])
def test_classification(spark, true, pred, accuracy, kappa):
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(true, pred)], "y_true int, y_pred int")
    got = metrics.classification_metrics(rows).first()
    assert (got.accuracy, got.kappa) == pytest.approx((accuracy, kappa))
    assert sum(r.n for r in metrics.confusion(rows).collect()) == 4


def test_confusion_by_key_has_empty_cells(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 0, 0), ("b", 2, 2)], "k string, y_true int, y_pred int")
    got = {(r.k, r.y_true, r.y_pred): r.n for r in metrics.confusion(rows, ["k"]).collect()}
    assert got == {("a", 0, 0): 1, ("a", 0, 1): 1, ("a", 1, 0): 0, ("a", 1, 1): 0, ("b", 2, 2): 1}


def test_ranks_with_ties(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.5), (4, 2.0)], "i int, v double")
    assert {r.i: r["rank"] for r in metrics.average_ranks(rows, "v").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: 4.0}


def test_drift_by_hand(spark):
    units = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (2, 0, 3.0), (3, 1, 10.0), (4, 1, 20.0), (5, 1, 30.0), (6, 2, 5.0)], "unit_id long, grp int, y double")
    chosen = units.where("unit_id in (0, 3)").select("unit_id")
    got = metrics.drift_summary(units, chosen, "y").first()
    assert (got.max_drift, got.mean_drift, got.tau) == (10.0, 5.5, 1.0)


def kendall_b(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
    a = sum(x[i] != x[j] for i in range(n) for j in range(i))
    b = sum(y[i] != y[j] for i in range(n) for j in range(i))
    return s / np.sqrt(a * b)


def test_rank_correlations_with_ties(spark):
    random = np.random.default_rng(1)
    x, y = random.integers(0, 5, 30), random.integers(0, 5, 30)
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x int, y int")
    assert metrics.kendall(rows, "x", "y", "i").first().tau == pytest.approx(kendall_b(x, y))
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert metrics.spearman(rows, "x", "y").first().rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert metrics.spearman(rows.limit(2), "x", "y").first().rho is None


def test_friedman_with_ties(spark):
    """Against the definition by sums of squares of ranks, which needs no tie correction."""
    random = np.random.default_rng(2)
    values = random.integers(0, 3, (12, 4)).astype(float)
    rows = spark.createDataFrame([(f"m{j}", "rmse", int(i), float(values[i, j])) for i in range(12) for j in range(4)], "method string, metric string, rep int, value double")
    ranks = np.array([[(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v] for v in values])
    between = 12 * ((ranks.mean(axis=0) - 2.5) ** 2).sum()
    within = ((ranks - 2.5) ** 2).sum() / (12 * 3)
    assert comparison.friedman(rows).first().chi_square == pytest.approx(between / within)


def test_dominance_and_effects(spark):
    rows = spark.createDataFrame([("a", "rmse", 1.0), ("b", "rmse", 2.0), ("c", "rmse", 1.0), ("a", "accuracy", 0.9), ("b", "accuracy", 0.8), ("c", "accuracy", 0.9)], "method string, metric string, mean double")
    got = {(r.method, r.other): r.dominates for r in comparison.dominance(rows).collect()}
    assert got["a", "b"] and not got["b", "a"] and not got["a", "c"]
    effect = {r.metric: r for r in comparison.effect_isolation(rows, "c", "b", "a").collect()}["rmse"]
    assert (effect.constraint_effect, effect.objective_effect, effect.total_effect, effect.total_pct) == (-1.0, 0.0, -1.0, -50.0)


def test_fronts_against_brute_force(spark):
    random = np.random.default_rng(3)
    f = random.integers(0, 8, (40, 3)).astype(float)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(f)], "candidate int, a double, b double, c double")
    want = {i for i in range(40) if not any((f[j] <= f[i]).all() and (f[j] < f[i]).any() for j in range(40))}
    assert {r.candidate for r in comparison.non_dominated(rows, ["a", "b", "c"]).collect()} == want


def test_hypervolume_by_hand(spark):
    rows = spark.createDataFrame([(0, 1.0, 3.0), (1, 2.0, 1.0), (2, 5.0, 0.0)], "candidate int, a double, b double")
    assert comparison.hypervolume(rows, "a", "b", (4.0, 4.0)).first().hypervolume == 3 * 1 + 2 * 2
    two = rows.where("candidate < 2")
    assert {r.candidate: r.contribution for r in comparison.hypervolume_contribution(two, "a", "b", (4.0, 4.0)).collect()} == {0: 1.0, 1: 4.0}


def test_power_law(spark):
    rows = spark.createDataFrame([(float(k), 3.0 * k**1.5) for k in (1, 2, 5, 9)] + [(0.0, 5.0)], "k double, t double")
    got = comparison.power_law(rows, "k", "t").first()
    assert (got.n, got.coefficient, got.exponent, got.r2) == pytest.approx((4, 3.0, 1.5, 1.0))
