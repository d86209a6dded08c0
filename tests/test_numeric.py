import numpy as np
import pytest
from landmarq.functions import vectors
from landmarq.operators import embedding, evolution, geometry, kernels, linear, models, objectives, panel, quotas, selectors
from landmarq.operators.groups import group_shares
from pyspark.sql import functions as F

X = np.random.default_rng(7).normal(size=(120, 6))


@pytest.fixture(scope="module")
def units(spark):
    rows = [(i, "ABC"[i % 3], [float(v) for v in x], float(1 + i % 4), float(x[0] - 2 * x[1] + 0.5)) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "unit_id long, grp string, vec array<double>, weight double, y double").repartition(3).cache()


def ids(frame):
    return sorted(r.unit_id for r in frame.collect())


# -- kernels ----------------------------------------------------------------


def test_kernel_values(spark):
    x = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([2.0, 2.0], [2.0, 2.0])], "a array<double>, b array<double>")
    got = [r.k for r in x.select(vectors.gaussian_kernel(F.col("a"), F.col("b"), 1.0).alias("k")).collect()]
    assert got == pytest.approx([np.exp(-0.5), np.exp(-1), 1.0])


def test_divergences_of_gaussians(spark):
    random = np.random.default_rng(0)
    rows = [tuple(random.uniform(-1, 1, 5).tolist() if i % 2 == 0 else random.uniform(0.1, 2, 5).tolist() for i in range(4)) for _ in range(20)]
    frame = spark.createDataFrame(rows, "mp array<double>, vp array<double>, mq array<double>, vq array<double>")
    a = [F.col(c) for c in frame.columns]
    got = frame.select(vectors.symmetric_kl_gaussians(*a).alias("s"), vectors.symmetric_kl_gaussians(a[2], a[3], a[0], a[1]).alias("t"), vectors.kl_gaussians(*a).alias("p"), vectors.kl_gaussians(a[2], a[3], a[0], a[1]).alias("q"), vectors.symmetric_kl_gaussians(a[0], a[1], a[0], a[1]).alias("z")).collect()
    for r in got:
        assert r.s == pytest.approx(r.t) and r.s == pytest.approx(r.p + r.q) and r.s >= 0 and r.z == pytest.approx(0)


def test_mean_discrepancy(units):
    features = kernels.RandomFeatures.build(6, 2000, 4.0)
    whole = units.select(F.lit(0).alias("candidate"), "unit_id").union(units.where("unit_id < 20").select(F.lit(1), "unit_id"))
    got = {r.candidate: r.mmd2 for r in kernels.mmd2(units, whole, features).collect()}
    exact = geometry.mmd_exact(units, units.where("unit_id < 20"), 4.0).first().mmd2
    assert got[0] == pytest.approx(0, abs=1e-12) and got[1] == pytest.approx(exact, rel=0.25)


def test_leverage(units):
    features = kernels.RandomFeatures.build(6, 40, 4.0)
    phi = features(X)
    want = np.diag(phi @ np.linalg.inv(phi.T @ phi + 0.1 * np.eye(40)) @ phi.T)
    scored = kernels.leverage_scores(units, features, 0.1)
    got = {r.unit_id: r.leverage for r in scored.collect()}
    assert [got[i] for i in range(120)] == pytest.approx(want.tolist())
    assert kernels.effective_dimension(scored) == pytest.approx(want.sum())


def test_nystrom_improves_with_more_points(units):
    errors = [kernels.nystrom_error(units, kernels.Nystrom.fit(X[:k], 6.0)) for k in (10, 40, 120)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-3
    distortions = [kernels.kernel_pca_distortion(units, kernels.Nystrom.fit(X[:k], 6.0)) for k in (10, 120)]
    assert distortions[0] > distortions[1]


def test_kernel_ridge_learns(units):
    train, test = units.where("unit_id % 5 > 0"), units.where("unit_id % 5 = 0")
    model = kernels.Nystrom.fit(X[:60], 20.0)
    rows = kernels.kernel_ridge(train, test, model, "y").collect()
    error, spread = np.mean([(r.y - r.y_pred) ** 2 for r in rows]), np.var([r.y for r in rows])
    assert error < 0.1 * spread


def test_transport(units):
    x = X[:50]
    anchors = kernels.Anchors.build(units.where("unit_id < 50"), 50)
    assert anchors.divergence(x) == pytest.approx(0, abs=1e-6) and anchors.divergence(x + 5) > 0.5
    cost = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert kernels.transport_cost(np.array([0.5, 0.5]), np.array([0.5, 0.5]), cost, 0.01, 500) == pytest.approx(0, abs=1e-3)
    assert kernels.transport_cost(np.array([1.0, 0.0]), np.array([0.0, 1.0]), cost, 0.05, 500) == pytest.approx(1, abs=1e-3)


def test_log_determinant_prefers_spread():
    assert kernels.negative_log_determinant(X[:5] * 10, 1.0) < kernels.negative_log_determinant(X[:5] * 0.01, 1.0)


def test_every_pair_in_chunks(units, monkeypatch):
    """The discrepancy of all units by chunks is that of whole matrices; rows without a whole vector take no part."""
    whole = kernels.gaussian(X, X, 4.0)
    some = [i for i in range(120) if i % 7 == 0]
    want = whole.mean() + whole[np.ix_(some, some)].mean() - 2 * whole[:, some].mean()
    monkeypatch.setattr(kernels, "CHUNK", 32)
    holed = units.select("unit_id", "vec").union(units.selectExpr("unit_id + 1000", "if(unit_id < 3, null, array(double(null)))").limit(5))
    assert geometry.mmd_exact(holed, units.where("unit_id % 7 = 0"), 4.0).first().mmd2 == pytest.approx(want, abs=1e-12)
    assert geometry.mmd_exact(units.where("false"), units, 4.0).first().mmd2 is None
    plan = geometry.mmd_exact(units, units, 4.0)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_kernel_errors_over_all_units(units, monkeypatch):
    """Errors and eigenvalues by chunks and passes are those of whole matrices, beyond what the driver may gather."""
    whole = kernels.gaussian(X, X, 4.0)
    model = kernels.Nystrom.fit(X[:30], 4.0)
    near = model(X) @ model(X).T
    true = np.sort(np.linalg.eigvalsh(kernels.centred(whole)))[::-1][:20]
    about = np.sort(np.linalg.eigvalsh(kernels.centred(near)))[::-1][:20]
    monkeypatch.setattr(kernels, "CHUNK", 32)
    monkeypatch.setattr(kernels.matrix, "__defaults__", ("vec", 10))
    assert kernels.nystrom_error(units, model) == pytest.approx(np.linalg.norm(whole - near) / np.linalg.norm(whole), rel=1e-9)
    assert kernels.leading_eigenvalues(units, 4.0, 20, small=0) == pytest.approx(true, rel=1e-8)
    assert kernels.kernel_pca_distortion(units, model) == pytest.approx(np.linalg.norm(true - about) / np.linalg.norm(true), rel=1e-6)


def test_too_many_vectors(units):
    with pytest.raises(ValueError):
        kernels.matrix(units, most=10)


# -- geometry ---------------------------------------------------------------


def test_coverage_by_brute_force(units):
    chosen = units.where("unit_id < 7").select("unit_id")
    d = np.sqrt(((X[:, None] - X[None, :7]) ** 2).sum(2)).min(1)
    got = geometry.coverage(units, chosen).first()
    assert (got.mean_distance, got.k_center) == pytest.approx((d.mean(), d.max()))
    assert geometry.coverage(units, chosen, "weight").first().k_median == pytest.approx((d * (1 + np.arange(120) % 4)).sum())
    assert geometry.diversity(units, units.limit(1).select("unit_id")).first().least == float("inf")
    error = geometry.representation_error(units.select("unit_id", "vec"), chosen).first()
    assert error.mean_error == pytest.approx(np.linalg.norm(X.mean(0) - X[:7].mean(0)))
    assert error.covariance_error == pytest.approx(np.linalg.norm(np.cov(X.T) - np.cov(X[:7].T)))


# -- selectors --------------------------------------------------------------


@pytest.mark.parametrize("method", sorted(selectors.METHODS))
def test_selectors(units, method):
    got = selectors.select(units, method, 10, seed=1, sigma_sq=4.0)
    assert len(set(ids(got))) == 10 and ids(got) == ids(selectors.select(units.repartition(5), method, 10, seed=1, sigma_sq=4.0))
    wanted = quotas.quota_counts(group_shares(units), 11)
    chosen = selectors.select(units, method, quotas=wanted, seed=1, sigma_sq=4.0)
    assert quotas.quota_satisfaction(units, chosen, wanted).first().satisfied


@pytest.mark.parametrize("method", ["farthest", "herding", "kmeans"])
def test_large_tables_go_in_parts(units, method):
    assert len(set(ids(selectors.select(units, method, 8, seed=1, sigma_sq=4.0, pool=30)))) == 8


def test_selectors_in_memory():
    random = lambda: np.random.default_rng(0)
    far = selectors.farthest_first(X, 8, random())
    for t in range(1, 8):
        d = ((X[:, None] - X[far[:t]][None]) ** 2).sum(2).min(1)
        assert d[far[t]] == pytest.approx(d.max())
    def gap(chosen):
        k = kernels.gaussian(X, X, 4.0)
        return k[np.ix_(chosen, chosen)].mean() - 2 * k[chosen].mean() + k.mean()
    chance = np.mean([gap(random().permutation(120)[:16])] + [gap(np.random.default_rng(s).permutation(120)[:16]) for s in range(30)])
    assert gap(selectors.thinning(X, 16, random(), sigma_sq=4.0)) < 0.5 * chance
    assert gap(selectors.herding(X, 16, random(), sigma_sq=4.0)) < 0.7 * chance
    diverse = selectors.determinantal(X, 10, random(), sigma_sq=4.0)
    assert kernels.negative_log_determinant(X[diverse], 4.0) < kernels.negative_log_determinant(X[:10], 4.0)


def test_distributed_variants(units):
    assert len(set(ids(selectors.kmeans_select(units, 9)))) == 9
    wanted = quotas.quota_counts(group_shares(units), 9)
    assert quotas.quota_satisfaction(units, selectors.leverage_select(units, 9, 4.0, 32, quotas=wanted), wanted).first().satisfied
    assert quotas.quota_satisfaction(units, selectors.global_then_quota(units, "farthest", wanted, 9), wanted).first().satisfied


# -- search -----------------------------------------------------------------


def test_sorting():
    f = np.random.default_rng(5).integers(0, 6, (60, 2)).astype(float)
    left, want = set(range(60)), []
    while left:
        layer = {i for i in left if not any((f[j] <= f[i]).all() and (f[j] < f[i]).any() for j in left)}
        want.append(sorted(layer))
        left -= layer
    assert [sorted(p.tolist()) for p in evolution.fronts(f)] == want
    parts = evolution.constrained_fronts(np.array([(1, 2), (0.5, 0.5), (0.1, 0.1), (0.3, 0.3)]), np.array([0, 0, 0.5, 0.3]))
    assert [p.tolist() for p in parts] == [[1], [0], [3, 2]]
    assert evolution.survivors(np.array([(1, 2), (0.5, 0.5), (0.1, 0.1), (0.3, 0.3)]), np.array([0, 0, 0.5, 0.3]), 3)[0].tolist() == [1, 0, 3]


def test_variation_keeps_sizes():
    random = np.random.default_rng(0)
    groups = np.arange(30) % 3
    members = [np.flatnonzero(groups == g) for g in range(3)]
    for _ in range(50):
        a, b = (np.sort(random.choice(30, 9, replace=False)) for _ in range(2))
        c, e = evolution.crossover(random, a, b, 1.0)
        assert np.intersect1d(a, b).tolist() == np.intersect1d(np.intersect1d(c, e), np.union1d(a, b)).tolist()
        fixed = evolution.repair_quotas(random, c, groups, members, np.array([2, 3, 4]))
        assert np.bincount(groups[fixed], minlength=3).tolist() == [2, 3, 4]
        moved = evolution.swap_within_groups(random, fixed, groups, members, 2)
        assert np.bincount(groups[moved], minlength=3).tolist() == [2, 3, 4] and len(set(moved)) == 9
        assert len(evolution.repair_size(random, e, 30, 7)) == 7
    assert len(evolution.least_harm_size(np.arange(5), 30, 8, lambda s: float(s.sum()), random)) == 8
    assert evolution.least_harm_size(np.arange(5), 30, 3, lambda s: float(s.sum()), random).tolist() == [0, 1, 2]


def test_repair_lowers_violations():
    random = np.random.default_rng(1)
    groups = np.repeat([0, 1, 2], [60, 20, 20])
    members = [np.flatnonzero(groups == g) for g in range(3)]
    weights = random.lognormal(0, 1, 100) * np.where(groups == 0, 3, 1)
    limits = [evolution.Proportionality(np.array([0.6, 0.2, 0.2]), None, 1.0, 0.01), evolution.Proportionality(np.bincount(groups, weights) / weights.sum(), weights, 1.0, 0.02)]
    bad = np.r_[members[1][:10], members[2][:10]]
    fixed = evolution.repair_constraints(bad, groups, members, limits, random)
    total = lambda s: sum(c.violation(s, groups) for c in limits)
    assert len(fixed) == 20 and total(fixed) < 0.3 * total(bad)
    start = evolution.greedy_start(groups, members, limits[:1], 20, random)
    assert limits[0].violation(start, groups) == 0


def test_search_beats_chance_and_keeps_limits(units):
    spread = lambda c: c.join(units.select("unit_id", "vec"), "unit_id").groupBy("candidate").agg(F.abs(F.avg(F.col("vec")[0])).alias("a"), F.abs(F.avg(F.col("vec")[1])).alias("b"))
    found = evolution.search(units, 12, spread, ["a", "b"], {"count": 0.05}, population=16, generations=5, seed=1)
    assert all(len(set(s)) == 12 for s in found.ids) and (found.violations <= 0).all()
    chance = quotas.random_candidates(units, 30, 12)
    assert found.objectives.sum(1).min() < np.median([r.a + r.b for r in spread(chance).collect()])
    again = evolution.search(units, 12, spread, ["a", "b"], {"count": 0.05}, population=16, generations=5, seed=1)
    assert [s.tolist() for s in found.ids] == [s.tolist() for s in again.ids]


@pytest.mark.parametrize("method", ["farthest", "determinantal", "herding", "plus_plus", "leverage"])
def test_greedy_selectors_choose_the_same_beyond_the_pool(units, method):
    """Passes over the table give the picks that one task makes, by size and by quota; some vectors come twice."""
    rows = units.union(units.withColumn("unit_id", F.col("unit_id") + 100_000).limit(15))
    ids = lambda frame: sorted(r.unit_id for r in frame.collect())
    for k in (1, 9):
        assert ids(selectors.select(rows, method, k, seed=4, sigma_sq=4.0, pool=30)) == ids(selectors.select(rows, method, k, seed=4, sigma_sq=4.0))
    wanted = rows.groupBy("grp").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("c"))
    if method != "leverage":
        assert ids(selectors.select(rows, method, quotas=wanted, seed=4, sigma_sq=4.0, pool=3)) == ids(selectors.select(rows, method, quotas=wanted, seed=4, sigma_sq=4.0))


def test_nearest_in_blocks(units, monkeypatch):
    """Beyond the size that is broadcast, blocks meet blocks; nothing changes."""
    few = units.where("unit_id % 3 = 0")
    rows = lambda frame: sorted(map(tuple, frame.select("unit_id", "neighbour", "place").collect()))
    near = lambda: sorted((r[0], r[1], round(r[2], 9)) for r in geometry.nearest_chosen(units, few.select("unit_id")).collect())
    want, want_near = rows(geometry.nearest_neighbours(units, few, 4)), near()
    monkeypatch.setattr(geometry, "BROADCAST_ROWS", 7)
    assert rows(geometry.nearest_neighbours(units, few, 4)) == want
    assert near() == want_near


@pytest.mark.parametrize(("hidden", "activation"), [(5, "tanh"), ((7, 4), "tanh"), ((6, 5, 4), "relu")])
def test_autoencoder_gradients(hidden, activation):
    """Slopes of every layer against small differences of the loss."""
    random = np.random.default_rng(1)
    model = embedding.Autoencoder(embedding.MixedColumns((0, 1), (2,), ((3, 3),)), 2, hidden, 3, activation)
    x = model.columns.inputs(np.column_stack([random.normal(size=(20, 2)), random.integers(0, 2, 20), random.integers(0, 3, 20)]))
    model._start(x.shape[1])
    model.weights |= {k: random.normal(0, 0.3, w.shape) for k, w in model.weights.items() if k[0] == "b"}  # off the corners of relu
    noise = random.normal(size=(20, 2))
    _, grads = model._loss(x, noise, 0.7)
    assert set(grads) == set(model.weights)
    for name, slope in grads.items():
        at = tuple(random.integers(0, n) for n in slope.shape)
        value = model.weights[name][at]
        sides = []
        for step in (1e-5, -1e-5):
            model.weights[name][at] = value + step
            sides.append(model._loss(x, noise, 0.7)[0])
        model.weights[name][at] = value
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(slope[at], abs=1e-5, rel=1e-4)


def test_mixed_starts():
    assert evolution.shares_of(10, [("a", 0.5), ("b", 0.25), ("c", 0.25)]) == ["a"] * 5 + ["b"] * 2 + ["c"] * 3
    assert evolution.shares_of(3, [("a", 1)]) == ["a"] * 3 and evolution.shares_of(0, [("a", 1)]) == []
    with pytest.raises(ValueError):
        evolution.shares_of(3, [("a", 0.0)])
    random = np.random.default_rng(0)
    weights = np.r_[np.full(10, 100.0), np.full(90, 0.01), np.zeros(5)]
    drawn = np.concatenate([evolution.weighted_start(random, weights, 8) for _ in range(50)])
    assert (drawn < 10).mean() > 0.9 and (drawn < 100).all()
    assert all(len(set(evolution.weighted_start(random, weights, 103).tolist())) == 103 for _ in range(3))


def _spread(units):
    return lambda c: c.join(units.select("unit_id", "vec"), "unit_id").groupBy("candidate").agg(F.abs(F.avg(F.col("vec")[0])).alias("a"), F.abs(F.avg(F.col("vec")[1])).alias("b"))


def test_search_starts_by_weight_and_repairs_with_least_harm(units):
    rows = units.withColumn("gain", F.when(F.col("unit_id") % 10 == 0, 1000.0).otherwise(0.001))
    first = []
    evolution.search(rows, 8, _spread(rows), ["a", "b"], population=6, generations=1, seed=2, starts=(("weighted", 1.0),), start_weight="gain", crossover_chance=0.0, mutation_chance=0.0, on_generation=lambda g, pop, f: first.extend(pop))
    assert np.mean([i % 10 == 0 for s in first for i in s]) > 0.8
    asked = []
    harm = lambda s: asked.append(len(s)) or float(s.sum())
    found = evolution.search(rows, 8, _spread(rows), ["a", "b"], population=6, generations=2, seed=2, harm=harm, starts=(("uniform", 0.5), ("weighted", 0.5)), start_weight="gain")
    assert asked and all(len(set(s.tolist())) == 8 for s in found.ids)
    with pytest.raises(ValueError, match="unknown starts"):
        evolution.search(rows, 8, _spread(rows), ["a", "b"], starts=(("best", 1.0),))


def test_search_goes_on_from_its_checkpoint(spark, units, tmp_path):
    """A search that broke off after any generation ends as one that ran through."""
    options = {"population": 8, "generations": 4, "seed": 3}
    whole = evolution.search(units, 10, _spread(units), ["a", "b"], {"count": 0.05}, **options)
    path = f"file://{tmp_path}/state"

    class Stopped(Exception):
        pass

    def broken(generation, pop, f):
        if generation == 2:
            raise Stopped

    with pytest.raises(Stopped):
        evolution.search(units, 10, _spread(units), ["a", "b"], {"count": 0.05}, checkpoint=path, on_generation=broken, **options)
    assert [p.name for p in (tmp_path / "state").iterdir()] == ["generation-000001"]
    rest = []
    resumed = evolution.search(units, 10, _spread(units), ["a", "b"], {"count": 0.05}, checkpoint=path, on_generation=lambda g, pop, f: rest.append(g), **options)
    assert rest == [2, 3]
    assert [s.tolist() for s in resumed.ids] == [s.tolist() for s in whole.ids] and np.allclose(resumed.objectives, whole.objectives)
    assert resumed.log.columns.equals(whole.log.columns) and np.allclose(resumed.log.to_numpy(float), whole.log.to_numpy(float))
    with pytest.raises(ValueError, match="another search"):
        evolution.search(units, 11, _spread(units), ["a", "b"], {"count": 0.05}, checkpoint=path, **options)


# -- linear models and panels -----------------------------------------------


def test_linear_models(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + 0.01 * random.normal(size=400)
    rows = spark.createDataFrame([(int(i), *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "time long, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    sums = linear.gram(rows, names, "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    ols = linear.least_squares(sums)
    assert [ols.intercept, *ols.weights] == pytest.approx(want.tolist())
    assert ols.error(sums) == pytest.approx(((y - x @ want[1:] - want[0]) ** 2).mean())
    folds = linear.expanding_folds(rows, names, "y", "time")
    assert len(folds) == 6 and sum(f.n for f in folds) == 400
    for model in (linear.ridge_by_folds(folds), linear.partial_least_squares(folds), linear.elastic_net(sums, 1e-4)):
        assert model.weights == pytest.approx([1, -2, 0.5], abs=0.02)
    assert linear._pls(sums, 3).weights == pytest.approx(ols.weights)
    mixed = linear.gram(rows.withColumn("y", 0.45 * F.col("a") + 0.35 * F.col("b") + 0.2 * F.col("c")), names, "y")
    assert linear.constrained_least_squares(mixed, spread=0.0).weights == pytest.approx([0.45, 0.35, 0.2], abs=1e-4)
    edge = linear.constrained_least_squares(linear.gram(rows.withColumn("y", 0.9 * F.col("a") + 0.1 * F.col("b")), names, "y")).weights
    assert edge.sum() == pytest.approx(1) and edge[0] == pytest.approx(0.5) and (edge >= 0.05 - 1e-9).all()


def test_panels(spark):
    rows = spark.createDataFrame([(e, t, float(e * 100 + t * t)) for e in range(3) for t in range(6)] + [(None, 0, 1.0)], "entity int, time int, v double")
    got = {(r.entity, r.time): (r.v_lag1, r.v_lag2) for r in panel.lagged(rows, ["v"], 2).collect()}
    assert len(got) == 12 and got[1, 2] == (101.0, 100.0)
    means = panel.entity_means(rows.where("entity < 2"), ["v"])
    inner = panel.demean(rows, means, ["v"])
    back = {(r.entity, r.time): r.v for r in panel.reinflate(inner, means, ["v"]).collect()}
    assert back == pytest.approx({(r.entity, r.time): r.v for r in rows.collect()})
    assert inner.where("entity = 0").agg(F.sum("v")).first()[0] == pytest.approx(0)


def test_models(units):
    train, test = units.where("unit_id % 4 > 0"), units.where("unit_id % 4 = 0")
    got = {(r.model, r.metric): r.value for r in models.evaluate_all(train, test, ["y"]).collect()}
    assert got["ridge", "rmse"] < 0.05 and set(m for m, _ in got) == {"knn", "forest", "boosting", "ridge"}
    marked = lambda x: x.withColumn("c", (F.col("y") > 0.5).cast("int"))
    found = {r.model: r for r in models.evaluate_classification(marked(train), marked(test), "c", ("knn", "logistic")).collect()}
    assert found["logistic"].accuracy > 0.9
    assert models.evaluate_classification(train.withColumn("c", F.lit(0)), test, "c") is None


# -- representations --------------------------------------------------------


def test_components(units):
    model = embedding.fit_components(units, 3)
    centred = X - X.mean(0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2 / 119
    assert model.variances == pytest.approx(values[:3]) and model.explained == pytest.approx(values[:3] / values.sum())
    got = np.array([r.pca for r in model.embed(units).orderBy("unit_id").collect()])
    assert np.abs(got.T @ got / 119 - np.diag(values[:3])).max() < 1e-9
    two = embedding.IncrementalComponents(3).add(units.where("unit_id < 50")).add(units.where("unit_id >= 50")).fit()
    assert two.directions == pytest.approx(model.directions)
    assert embedding.components_for_variance(units, 0.999999) == 6 and embedding.components_for_variance(units, values[0] / values.sum() * 0.99) == 1
    white = embedding.fit_components(units, 2, whiten=True)
    assert white(X).std(axis=0, ddof=1) == pytest.approx([1, 1])


def test_autoencoder(spark):
    random = np.random.default_rng(0)
    z = random.normal(size=(400, 2))
    x = np.column_stack([z @ random.normal(size=(2, 4)), z[:, 0] > 0, np.digitize(z[:, 1], [-0.5, 0.5])])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "unit_id long, vec array<double>")
    columns = embedding.MixedColumns((0, 1, 2, 3), (4,), ((5, 3),))
    model = embedding.Autoencoder(columns, 2, 32, seed=1).fit(rows, epochs=30)
    assert model.history[-1][1] < 0.8 * model.history[0][1]
    inputs = columns.inputs(x[:20])
    noise, base = random.normal(size=(20, 2)), model._loss
    grads = base(inputs, noise, 0.7)[1]
    for name in ("we0", "wm", "wv", "wd0", "wo", "bo"):  # gradients against differences
        at = tuple(0 for _ in model.weights[name].shape)
        keep = model.weights[name][at]
        model.weights[name][at] = keep + 1e-5
        up = base(inputs, noise, 0.7)[0]
        model.weights[name][at] = keep - 1e-5
        down = base(inputs, noise, 0.7)[0]
        model.weights[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)
    row = model.embed(rows).first()
    assert len(row.latent) == 2 and all(v > 0 for v in row.latent_var)


# -- objectives, targets and reports ------------------------------------------


def test_objectives_agree_with_their_parts(units):
    from landmarq.operators import objectives

    made = objectives.Objectives.build(units, 64, 16)
    candidates = quotas.random_candidates(units, 4, 15)
    got = {r.candidate: r for r in made.table(candidates).collect()}
    assert {c: r.mmd2 for c, r in got.items()} == pytest.approx({r.candidate: r.mmd2 for r in kernels.mmd2(units, candidates, made.features).collect()})
    assert {c: r.skl for c, r in got.items()} == pytest.approx({r.candidate: r.skl for r in geometry.subset_symmetric_kl(units, candidates).collect()})
    assert {c: r.sinkhorn for c, r in got.items()} == pytest.approx({r.candidate: r.sinkhorn for r in kernels.sinkhorn(units, candidates, made.anchors).collect()})
    one = units.where("unit_id < 30")
    assert objectives.mmd2_between(units, one, one, made.features) == pytest.approx(0, abs=1e-15)
    with pytest.raises(ValueError):
        made.table(candidates, ["nothing"])


@pytest.mark.parametrize("method", ["kmeans", "farthest"])
def test_anchors_are_the_same_beyond_the_pool(units, method):
    """All units stand behind the anchors, whether they are held or gone over."""
    held, over = (kernels.Anchors.build(units, 8, method, pool=p) for p in (200, 20))
    order = [a.points[np.lexsort(a.points.T)] for a in (held, over)]
    assert order[0] == pytest.approx(order[1], abs=1e-9) and sorted(held.weights) == pytest.approx(sorted(over.weights))
    assert held.divergence(X[:20]) == pytest.approx(over.divergence(X[:20]), abs=1e-9)


def test_bandwidth_of_objectives_goes_by_the_sample_asked_for(units):
    built = objectives.Objectives.build(units, 16, 4, sample=30)
    assert built.sigma_sq == geometry.median_squared_distance(units, 30) / 2 != objectives.Objectives.build(units, 16, 4).sigma_sq


def test_exact_determinantal_chances():
    """Chances of all pairs against determinants."""
    import itertools

    a = np.random.default_rng(0).normal(size=(5, 5))
    kernel, random, counts = a @ a.T, np.random.default_rng(1), {}
    for _ in range(4000):
        pair = tuple(sorted(selectors.sample_determinantal(kernel, 2, random).tolist()))
        counts[pair] = counts.get(pair, 0) + 1
    pairs = list(itertools.combinations(range(5), 2))
    dets = np.array([np.linalg.det(kernel[np.ix_(p, p)]) for p in pairs])
    assert np.abs(np.array([counts.get(p, 0) / 4000 for p in pairs]) - dets / dets.sum()).max() < 0.03


def test_determinantal_draws_from_a_table(spark):
    """Chances of all pairs of units against determinants, two copies among them; tables of any size have that way."""
    import itertools

    a = np.random.default_rng(0).normal(size=(5, 3))
    a[4] = a[1]
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(a)], "unit_id long, vec array<double>")
    rows = selectors.draw_determinantal(frame.select("unit_id", "vec"), 2, 2.0, seed=1, draws=60).collect()
    assert len(rows) == 120 and {1, 4} not in [{r.unit_id for r in rows if r.draw == d} for d in range(60)]
    apart = frame.where("unit_id < 4")
    rows = selectors.draw_determinantal(apart, 2, 2.0, seed=1, draws=2500).collect()
    found, counts = {}, {}
    for r in rows:
        found.setdefault(r.draw, []).append(r.unit_id)
    for pair in found.values():
        counts[tuple(sorted(pair))] = counts.get(tuple(sorted(pair)), 0) + 1
    pairs = list(itertools.combinations(range(4), 2))
    kernel = kernels.gaussian(a, a, 2.0)
    dets = np.array([np.linalg.det(kernel[np.ix_(p, p)]) for p in pairs])
    assert len(found) == 2500 and np.abs(np.array([counts.get(p, 0) / 2500 for p in pairs]) - dets / dets.sum()).max() < 0.04
    with pytest.raises(ValueError):
        selectors.draw_determinantal(frame, 5, 2.0)


def test_weights_of_copies():
    """How many classes of each weight are drawn, against every set."""
    import itertools

    weights = [1, 1, 1, 3, 3, 7]
    shares = selectors._weight_shares(np.array([1, 3, 7]), np.array([3, 2, 1]), 3)
    sets = list(itertools.combinations(range(6), 3))
    mass = np.array([np.prod([weights[i] for i in s]) for s in sets], float)
    assert shares[2][3][1] == pytest.approx(mass[[5 in s for s in sets]].sum() / mass.sum())
    pairs = list(itertools.combinations(range(5), 2))
    mass = np.array([np.prod([weights[i] for i in s]) for s in pairs], float)
    assert shares[1][2] == pytest.approx([mass[[sum(i > 2 for i in s) == j for s in pairs]].sum() / mass.sum() for j in range(3)])


def test_growing_limits_and_floors(units):
    floors = evolution.greedy_floors(units, 12)
    assert 0 <= floors["count"] < 0.05 and set(floors) == {"count", "weight"}
    spread = lambda c: c.join(units.select("unit_id", "vec"), "unit_id").groupBy("candidate").agg(F.abs(F.avg(F.col("vec")[0])).alias("a"), F.abs(F.avg(F.col("vec")[1])).alias("b"))
    found, limits = evolution.search_with_growing_limits(units, 12, spread, ["a", "b"], ("count", "weight"), population=10, generations=2, rounds=8)
    assert (found.violations <= 0).mean() >= 0.5 and limits["count"] >= floors["count"]
    assert {"repaired", "repair_size", "diversity"} <= set(found.log.columns)
    random = np.random.default_rng(0)
    groups = np.arange(30) % 3
    members = [np.flatnonzero(groups == g) for g in range(3)]
    got = evolution.least_harm_quotas(np.arange(9), groups, members, np.array([2, 3, 4]), lambda s: float(s.sum()), random)
    assert np.bincount(groups[got]).tolist() == [2, 3, 4]


def test_related_columns():
    from landmarq.operators import targets

    columns = ["Densidade_SCM_2020", "Densidade_SCM_2021", "Acessos_SCM_2020", "pct_urbano", "pct_rural", "free", "free_missing"]
    assert targets.related_columns("Densidade_SCM_2020", columns) == ["Acessos_SCM_2020", "Densidade_SCM_2021"]
    assert targets.related_columns("pct_urbano__tercile", columns) == ["pct_rural", "pct_urbano"]
    assert targets.related_columns("free", columns) == [] and "free_missing" not in targets.substantive(columns)
    draws = targets.draw_targets(["a", "b", "c"], ["a__tercile", "d"], 20, 2, 1, seed=1)
    assert len(draws) == 20 and all(len(set(r)) == 2 and not ("a" in r and "a__tercile" in c) for r, c in draws)
    assert draws == targets.draw_targets(["a", "b", "c"], ["a__tercile", "d"], 20, 2, 1, seed=1)


def test_reports(spark, units, tmp_path):
    from landmarq.plans import reports

    results = spark.createDataFrame([("a", "rmse", 1.0), ("b", "rmse", -1.0), ("a", "tau", 0.5)], "method string, metric string, value double")
    assert [r.metric for r in reports.out_of_bounds(results).collect()] == ["rmse"]
    reports.comparison_report(results, f"file://{tmp_path}/c", {"a": "b"})
    assert spark.read.parquet(f"file://{tmp_path}/c/ranks").count() == 3
    rows = spark.createDataFrame([("r", 1.5, 1.0), ("r", 2.7, 2.0), ("c", 1.0, 1.0), ("c", 0.0, 1.0)], "target string, y_true double, y_pred double")
    got = {(r.target, r.metric) for r in reports.evaluate_auto(rows, ["r", "c"]).collect()}
    assert ("r", "rmse") in got and ("c", "accuracy") in got
    wide = units.select("unit_id", "grp", "weight", "y")
    first = reports.build_replicate(wide, {"y": "numeric"}, f"file://{tmp_path}/rep", 0, 50)
    assert first.agg(F.count_if("is_eval")).first()[0] == 50 and first.where("is_eval_test and is_eval_train").isEmpty()
    assert reports.build_replicate(wide, {"y": "numeric"}, f"file://{tmp_path}/rep", 0, 50).count() == 120
    ids_of = reports.repair_baseline(units, units.where("grp = 'A'").limit(9), 12, {"count": 0.02})
    assert len(set(ids_of)) == 12
    times = reports.time_methods(units, ["uniform"], [5, 10])
    assert times.count() == 2
