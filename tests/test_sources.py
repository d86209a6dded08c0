import zipfile

import pytest
from landmarq.plans import experiment
from landmarq.sources import readers, sinks
from pyspark.sql import functions as F


def test_csv_in_archives(spark, tmp_path):
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"a{i}.zip", "w") as out:
            out.writestr("deep/er/Data_2020.CSV", "no\n1\n")
            out.writestr("x/DATA_2020.csv", f"id;name;v\n{i};ação;1.5\n{i + 10};b;oops\n".encode("utf-8"))
    got = readers.read_zipped_csv(spark, f"file://{tmp_path}/*.zip", "data_2020.csv", "id long, name string, v double", ";")
    assert sorted(map(tuple, got.collect())) == [(0, "ação", 1.5), (1, "ação", 1.5), (10, "b", None), (11, "b", None)]
    with pytest.raises(Exception, match="nothing.csv"):
        readers.read_zipped_csv(spark, f"file://{tmp_path}/*.zip", "nothing.csv", "id long").count()


def test_file_lookup(tmp_path, spark):
    names = ["d/Populacao 2024.csv", "d/meta.csv", "d/long/meta.csv"]
    assert readers.resolve_file(names, "populacao_2024.csv") == names[0]
    assert readers.resolve_file(names, "none.csv", ["meta.csv"]) == "d/meta.csv"
    assert readers.resolve_file(names, "pop*") == names[0] and readers.resolve_file(names, "zzz") is None
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert readers.list_files(spark, f"file://{tmp_path}")[0].endswith("a.csv")


def test_loaders(spark):
    meta = spark.createDataFrame([("11", "1.5", "2", "AC"), ("11", "1.5", "2", "AC"), ("x", "0", "0", "SP")], "Cod_IBGE string, LON string, lat string, UF string")
    assert [tuple(r) for r in readers.load_metadata(meta).collect()] == [(11, 1.5, 2.0, "AC")]
    people = spark.createDataFrame([("1-1", "1.000,5", "acre"), ("11", "5", "acre"), ("", "7", "sp")], "id string, pop string, state string")
    assert [tuple(r) for r in readers.load_population(people).collect()] == [(11, 1000.5, "AC")]
    sectors = spark.createDataFrame([("123456789", 1.0), ("123456700", 2.0), ("999999900", 5.0)], "code string, v double")
    assert {r.codigo_ibge: r.v for r in readers.sum_to_parent(sectors, "code").collect()} == {1234567: 3.0, 9999999: 5.0}
    parts = readers.split_by_prefix(spark.createDataFrame([(1, 2, 3, 4)], "k int, cov_a int, y_b int, other int"), "k", ["cov_"], ["y_"])
    assert [p.columns for p in parts] == [["k", "cov_a"], ["k", "y_b"], ["k", "other"]]
    made = readers.synthetic_units(spark, 100, 4, 5, seed=1)
    assert made.count() == 100 and made.select("grp").distinct().count() == 5 and made.first().vec == readers.synthetic_units(spark, 100, 4, 5, seed=1).first().vec


def test_results_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("m,v\nx,1.5\n")
    (tmp_path / "b.csv").write_text("m,w\ny,2\n")
    got = {r.m: (r.v, r.w) for r in readers.read_results(spark, f"file://{tmp_path}/*.csv").collect()}
    assert got == {"x": (1.5, None), "y": (None, 2)}


def test_artifacts(spark, tmp_path):
    at, calls = f"file://{tmp_path}", []
    def build():
        calls.append(1)
        return spark.range(3).withColumnRenamed("id", "unit_id")
    for required in ([], [], ["more"]):
        sinks.build_once(spark, f"{at}/x", build, required)
    assert len(calls) == 2
    assert sinks.next_replicate(spark, at) == 0
    build().write.parquet(f"{at}/rep=0")
    assert sinks.next_replicate(spark, at) == 1
    sinks.save_selection(build(), f"{at}/s", method="a", rep=0)
    sinks.save_selection(build(), f"{at}/s", method="b", rep=1)
    assert sinks.load_selections(spark, f"{at}/s").count() == 6
    sinks.save_metrics(spark.createDataFrame([("k1", 1.0, 2)], "key string, a double, b int"), f"{at}/m", ["key"], run="r")
    assert {(r.key, r.run, r.metric, r.value) for r in spark.read.parquet(f"{at}/m").collect()} == {("k1", "r", "a", 1.0), ("k1", "r", "b", 2.0)}
    sinks.save_rows([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")], f"{at}/rows")
    assert spark.read.option("header", True).csv(f"{at}/rows").columns == ["a", "b"]
    sinks.save_manifest(spark, f"{at}/man", {"seed": 3})
    assert sinks.load_manifest(spark, f"{at}/man")["seed"] == 3
    done = []
    def step(i):
        done.append(i)
        return spark.createDataFrame([(i * 2,)], "v long")
    for _ in range(2):
        rows = sinks.run_resumable(spark, [1, 2], step, f"{at}/runs")
    assert done == [1, 2] and sorted(r.v for r in rows.collect()) == [2, 4]
    assert tuple(sinks.publish(rows.union(rows), f"{at}/pub", ["item"]).first()) == (2, 2, 0)
    splits = spark.range(4).select(F.col("id").alias("unit_id"), (F.col("id") > 1).alias("is_train"), F.lit(1).alias("extra"))
    sinks.save_splits(splits, f"{at}/sp")
    assert sinks.load_splits(spark, f"{at}/sp").columns == ["unit_id", "is_train"]
    sinks.remove(spark, f"{at}/sp")
    assert not sinks.is_complete(spark, f"{at}/sp")


def test_constrained_runs(spark):
    """Quotas hold exactly, limits are neared, a search of one objective gives one selection."""
    units = readers.synthetic_units(spark, 150, 5, 3, seed=2).withColumnRenamed("target", "y").withColumn("weight", (F.col("unit_id") % 7 + 1).cast("double")).cache()
    wanted = {r.grp: r.c for r in experiment.hard_quotas(units, 9, "weight").collect()}
    base = experiment.Settings(k=9, methods=("farthest",), evaluation_rows=60, population=6, generations=1)
    counts = lambda frame: {r.grp: r["count"] for r in units.join(frame, "unit_id").groupBy("grp").count().collect()}
    assert counts(experiment.constrained_selection(units, experiment.replace(base, hard="weight"), "farthest", "exact", 0, 4.0).select("unit_id")) == wanted
    assert experiment.constrained_selection(units, experiment.replace(base, limits={"count": 0.02}), "farthest", "exact", 0, 4.0).count() == 9
    for one in (experiment.replace(base, objectives=("mmd2",)), experiment.replace(base, hard="weight", limits={"count": 0.5}, objectives=("mmd2", "sinkhorn", "skl"))):
        found = experiment.search_selection(units, one, 4.0, 0)
        assert found.count() == 9 and (not one.hard or counts(found) == wanted)


def test_experiments(spark, tmp_path):
    units = readers.synthetic_units(spark, 150, 5, 3, seed=2).withColumnRenamed("target", "y").cache()
    settings = experiment.Settings(name="s", k=9, methods=("uniform", "farthest"), regimes=("exact", "quota"), evaluation_rows=80)
    rows = experiment.run_all(units, {"s": settings}, f"file://{tmp_path}/e", "y")
    assert {(r.regime, r.method) for r in rows.select("regime", "method").distinct().collect()} == {(a, b) for a in settings.regimes for b in settings.methods}
    kl = {r.regime: r.v for r in rows.where("metric = 'geo_kl'").groupBy("regime").agg(F.max("value").alias("v")).collect()}
    assert kl["quota"] <= kl["exact"] + 1e-12
    assert experiment.championship_of(rows).count() == 2
    specs = experiment.run_specs()
    waves = experiment.in_order(specs)
    assert waves[0] == ["R0"] and set(waves[2]) == {"R11", "D_raw", "D_vae", "D_pca"}
    assert {f"R{i}" for i in range(16)} | {f"G{i}" for i in range(1, 49)} | {f"{a}_{b}_{c}" for a in "NB" for b in "rvp" for c in experiment.CONSTRAINTS} <= set(specs)
    same = lambda a, b: experiment.replace(specs[a], name="") == experiment.replace(specs[b], name="")
    assert same("G5", "B_r_ph") and same("G8", "B_r_0") and same("G17", "N_r_ps") and same("G31", "B_r_ps") and same("G40", "B_r_hs") and same("G48", "B_p_hs") and same("G13", "B_v_ph")
    assert [x.k for x in experiment.sweep_settings(specs["R8"])] == list(experiment.SIZES) and [x.dimension for x in experiment.sweep_settings(specs["R13"])] == list(experiment.WIDTHS)
    assert len({x.name for x in experiment.sweep_settings(specs["R12"])}) == 4 and experiment.sweep_settings(specs["R6"])[0].name == "R6"
    with pytest.raises(ValueError):
        experiment.in_order({"a": experiment.Settings(after=("b",)), "b": experiment.Settings(after=("a",))})
    assert experiment.quota_report(units, [5, 9]).count() == 6
