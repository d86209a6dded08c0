import numpy as np
import pytest
from landmarq.functions import scalars
from landmarq.operators import prepare
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def mixed(spark):
    random = np.random.default_rng(42)
    rows = []
    for i in range(200):
        cat = None if 100 <= i < 120 else float(i % 3)
        rows.append((i, "g" + str(i % 4), float(random.normal()) if i % 10 else float("nan"), float(random.integers(1, 6)), cat, float(np.exp(random.normal(0, 3)) * 10), float("inf") if i == 5 else 1.0, i < 160))
    return spark.createDataFrame(rows, "unit_id long, grp string, num double, ord double, cat double, heavy double, odd double, is_train boolean")


def test_imputation_uses_training_rows_only(mixed):
    roles = {"num": prepare.NUMERIC, "ord": prepare.ORDINAL, "cat": prepare.CATEGORICAL, "odd": prepare.NUMERIC}
    table = mixed.toPandas()
    train = table[table.is_train]
    got = prepare.impute(mixed, roles).toPandas().sort_values("unit_id")
    assert got.num[0] == pytest.approx(np.nanmedian(train.num)) and got.odd[5] == 1.0
    counts = train.cat.value_counts()
    assert (got.cat[100:120] == min(counts[counts == counts.max()].index)).all()
    assert not got[["num", "ord", "cat", "odd"]].isna().any().any()
    plain = prepare.impute(mixed, roles, category_strategy="code").toPandas().sort_values("unit_id")
    assert (plain.cat[100:120] == -1).all()


def test_heavy_tails_and_indicators(mixed):
    assert prepare.heavy_tailed(mixed, ["num", "ord", "heavy"]) == ["heavy"]
    marked = prepare.missing_indicators(mixed, {"num": prepare.NUMERIC, "heavy": prepare.NUMERIC, "cat": prepare.CATEGORICAL, "odd": prepare.NUMERIC})
    assert [c for c in marked.columns if c.endswith("__missing")] == ["num__missing", "odd__missing"]
    assert marked.agg(F.sum("num__missing")).first()[0] == 20


def test_prepared_columns_are_standard_on_training_rows(mixed):
    got = prepare.prepare_features(mixed, {"num": prepare.NUMERIC, "heavy": prepare.NUMERIC}).toPandas()
    train = got[got.is_train]
    assert np.allclose(train[["num", "heavy"]].mean(), 0, atol=1e-9) and np.allclose(train[["num", "heavy"]].std(ddof=0), 1)


def test_roles(spark):
    rows = [(float(i), i % 5, "abc"[i % 3], i, i % 2 == 0, str(i * 1.5), f"x{i}", i) for i in range(100)]
    frame = spark.createDataFrame(rows, "continuous double, int_cat int, str_cat string, high_card_int int, bool_col boolean, texts_of_numbers string, many string, codigo_ibge int")
    roles = prepare.infer_roles(frame.withColumn("y_x", F.lit(1.0)), most_categories=50)
    assert roles.of == {
        "continuous": "numeric", "int_cat": "categorical", "str_cat": "categorical", "high_card_int": "numeric", "bool_col": "categorical", "texts_of_numbers": "numeric", "many": "ignore", "codigo_ibge": "ignore", "y_x": "target",
    }
    assert roles.cardinality["int_cat"] == 5 and roles.summary()["categorical"] == 3
    assert prepare.castable_columns(frame, ["codigo_ibge"]) == ["continuous", "int_cat", "high_card_int", "texts_of_numbers"]


def test_targets_do_not_leak(spark):
    frame = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "unit_id int, cov_area_4G double, HHI_SMP_2024 double, income double")
    assert prepare.drop_targets(frame).columns == ["unit_id", "income"]
    with pytest.raises(ValueError):
        prepare.check_no_leakage(["income", "pct_urbano"])
    with pytest.raises(ValueError):
        prepare.drop_targets(frame.select("cov_area_4G"))
    assert prepare.resolve_column(frame, ["nope", "INCOME"]) == "income" and prepare.resolve_column(frame, ["nope"], required=False) is None


def test_splits(spark):
    units = spark.range(500).select(F.col("id").alias("unit_id"), (F.col("id") % 5).alias("grp")).union(spark.createDataFrame([(999, 77)], "unit_id long, grp long"))
    marked = prepare.stratified_split(units, 0.2, seed=1)
    assert {r.n for r in marked.where("is_test and grp < 5").groupBy("grp").agg(F.count("*").alias("n")).collect()} == {20}
    counts = spark.createDataFrame([(g, 20) for g in range(5)] + [(77, 1)], "grp long, c long")
    both = prepare.split_within_groups(prepare.sample_by_group(units, counts, 2), 0.8, 3)
    report = prepare.split_report(both, 0.8).first()
    assert (report.evaluated, report.train, report.test, report.stray, report.worst_gap) == (101, 81, 20, 0, 0.0)


def test_codes_of_unseen_values(spark):
    seen = spark.createDataFrame([(v,) for v in ("banana", "apple", "cherry", "apple", "banana")], "cat string")
    new = spark.createDataFrame([(1, "banana"), (2, None), (3, "kiwi"), (4, "apple")], "i int, cat string")
    codes = prepare.category_codes(seen, "cat")
    assert [r.c for r in prepare.encode(new, "cat", codes, "c").orderBy("i").collect()] == [1, -1, -1, 0]


def test_a_label_with_a_rare_class_takes_its_fallback(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i == 0)) for i in range(200)], "unit_id long, populacao_2025 double, att09_any_present_5G double")
    made = prepare.derive_labels(rows, [prepare.Label("cross", "cross", ("populacao_2025", "att09_any_present_5G"), 0, 0.02, "second"), prepare.Label("even", "median", ("populacao_2025",), 0, 0.4)])
    assert made[1] == [] or "cross" not in made[1]
    wide = spark.createDataFrame([(i, float(i)) for i in range(10)], "unit_id long, pct_urbano double")
    rows, names = prepare.derive_labels(wide, [prepare.Label("u", "extreme", ("pct_urbano",), 0, 0.2, "tercile")])
    assert names == ["u"] and sorted(r.u for r in rows.collect()) == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_target_kind(spark):
    frame = spark.createDataFrame([(i % 3, i / 7, str(i)) for i in range(60)], "a int, b double, c string")
    assert [prepare.target_kind(frame, c) for c in "abc"] == ["classification", "regression", "classification"]


def test_scalars(spark):
    rows = spark.createDataFrame([("1.234,56", "12-3 4", "jan/2020", "rio de janeiro", float("nan")), ("-", "", "2020-7", "sp", float("inf")), (None, None, "7 2021", "xyz", 2.0)], "n string, i string, p string, u string, x double")
    got = rows.select(
        scalars.decimal_comma(F.col("n")).alias("n"), scalars.digits_id(F.col("i")).alias("i"), scalars.period_month(F.col("p")).alias("p"), scalars.region_code(F.col("u")).alias("u"), scalars.finite(F.col("x")).alias("x"), scalars.shown(F.col("x"), 1).alias("s")
    ).collect()
    assert [tuple(r) for r in got] == [(1234.56, 1234, "202001", "RJ", None, "---"), (None, -1, "202001", "SP", None, "---"), (None, -1, "202107", "XY", 2.0, "2.0")]


def test_noise_is_uniform(spark):
    u = np.array([r.u for r in spark.range(4000).select(scalars.uniform(1, F.col("id")).alias("u")).collect()])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(u.var() - 1 / 12) < 0.005
