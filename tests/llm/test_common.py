from landmarq.llm import _common
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_tidy_gives_settings_back(spark):
    before = spark.conf.get(CLEAN)
    try:
        with _common.tidy(spark):
            assert spark.conf.get(CLEAN) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(CLEAN) == before


def test_a_written_table_outlives_its_shuffles(spark):
    """Two tables of one plan with a shuffle: what the first write cleans away the second makes again."""
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    one, two = _common.materialise(rows, "one"), _common.materialise(rows.where("k > 2"), "two")
    assert one.count() == 7 and two.count() == 4 and rows.count() == 7
    _common.discard(one)
    assert not _common.exists(spark, one._landmarq_path) and two.count() == 4


def test_ids(spark):
    frame = lambda ids: spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "id long, t string")
    assert _common.has_unique_ids(frame([3, 1, 2]), "id") and _common.has_unique_ids(frame([]), "id")
    assert not _common.has_unique_ids(frame([3, 1, 3]), "id") and not _common.has_unique_ids(frame([3, None]), "id")
    rows = _common.numbered(frame([5, None, 2, 5, 9, None]).repartition(3), "id").orderBy("_number").collect()
    assert [r._number for r in rows] == list(range(6)) and [r.id for r in rows] == [2, 5, 5, 9, None, None]
    assert {r.t for r in rows} == {f"t{n}" for n in range(6)}
