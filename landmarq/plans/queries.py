"""The registered queries over the library's operators, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vectors as vec
from ..operators import comparison, geometry, groups, metrics, panel, prepare, quotas, targets
from ..sources import readers
from . import reports
from . import units as tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K = 100

# -- SQL that several queries share -----------------------------------------

UNITS = "units AS (SELECT c_custkey AS unit_id, c_nationkey AS grp, greatest(c_acctbal, 0) AS weight, c_acctbal AS balance, c_mktsegment AS segment FROM customer)"
SHARES = f"""{UNITS}, shares AS (SELECT grp, count(*) AS n, count(*) / (SELECT count(*) FROM units) AS pi, sum(weight) AS weight, sum(weight) / (SELECT sum(weight) FROM units) AS pi_weight FROM units GROUP BY grp)"""


def quota_sql(k: int, pi: str = "pi") -> str:
    return f"""{SHARES}, bounds AS (SELECT *, CASE WHEN {k} >= (SELECT count(*) FROM shares) THEN 1 ELSE 0 END AS lb, least(n, {k}) AS ub FROM shares),
    steps AS (SELECT grp, t, {pi} * (ln(t + 2) - ln(t + 1)) AS gain FROM bounds, range(0, {k}) r(t) WHERE t >= lb AND t < ub),
    best AS (SELECT grp FROM steps ORDER BY gain DESC, grp, t LIMIT ({k} - (SELECT sum(lb) FROM bounds))),
    quotas AS (SELECT b.grp, b.n, b.pi, (b.lb + (SELECT count(*) FROM best x WHERE x.grp = b.grp))::BIGINT AS c FROM bounds b)"""


def key_sql(seed: str, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'{c}::VARCHAR' for c in columns)}))"


SAMPLE = f"{quota_sql(K)}, ranked AS (SELECT u.*, row_number() OVER (PARTITION BY u.grp ORDER BY {key_sql('7', 'unit_id')}, unit_id) AS place FROM units u), chosen AS (SELECT r.* FROM ranked r JOIN quotas q USING (grp) WHERE place <= q.c)"
VECTORS = "v AS (SELECT vec_id AS unit_id, label AS grp, embedding::DOUBLE[] AS vec FROM embeddings)"
CHOSEN = f"{VECTORS}, s AS (SELECT unit_id FROM v ORDER BY {key_sql('3', 'unit_id')}, unit_id LIMIT 25), cv AS (SELECT v.* FROM v JOIN s USING (unit_id))"
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
PREDICTIONS = "p AS (SELECT o_orderstatus AS target, c_nationkey AS grp, o_totalprice AS y_true, c_acctbal * 1.7 + 100000 AS y_pred FROM orders JOIN customer ON o_custkey = c_custkey)"
RESULTS = """w AS (SELECT o_orderpriority AS method, n_regionkey AS rep, round(avg(o_totalprice), 4) AS rmse_price, round(stddev_pop(o_totalprice), 4) AS mae_price, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS accuracy_open
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT method, rep, 'rmse_price' AS metric, rmse_price AS value FROM w UNION ALL SELECT method, rep, 'mae_price', mae_price FROM w UNION ALL SELECT method, rep, 'accuracy_open', accuracy_open FROM w),
    z AS (SELECT *, CASE WHEN metric LIKE 'accuracy%' THEN -value ELSE value END AS s FROM r),
    m AS (SELECT method, metric, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM r GROUP BY ALL),
    ms AS (SELECT *, CASE WHEN metric LIKE 'accuracy%' THEN -mean ELSE mean END AS s FROM m)"""
BLOCKS = f"{RESULTS}, k AS (SELECT *, rank() OVER (PARTITION BY metric, rep ORDER BY s) + (count(*) OVER (PARTITION BY metric, rep, s) - 1) / 2 AS rank, min(s) OVER (PARTITION BY metric, rep) AS lo, max(s) OVER (PARTITION BY metric, rep) AS hi FROM z)"
FRONT = "f AS (SELECT p_brand AS candidate, round(avg(p_retailprice), 4) AS f1, round(avg(p_size), 4) AS f2, (-count(*))::DOUBLE AS f3 FROM part GROUP BY 1)"


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, infinities made null, all whole numbers long."""
    out = []
    for name, kind in frame.dtypes:
        if kind == "double":
            out.append(r(F.when(F.abs(F.col(name)) < float("inf"), F.col(name)), digits).alias(name))
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return frame.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir), digits)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def _selection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Units, shares, quotas of K and a quota sample."""
    units = tables.plain_units(spark, sf_dir)
    shares = groups.group_shares(units)
    wanted = quotas.quota_counts(shares, K)
    return units, shares, wanted, quotas.quota_sample(units, wanted, seed=7)


# -- groups -----------------------------------------------------------------


@query("group_shares", f"WITH {SHARES} SELECT grp::BIGINT AS grp, n, round(pi, 6) AS pi, round(weight, 6) AS weight, round(pi_weight, 6) AS pi_weight FROM shares")
def group_shares(spark, d):
    return groups.group_shares(tables.plain_units(spark, d))


@query("merge_small_groups", f"WITH {UNITS}, c AS (SELECT grp, count(*) AS n FROM units GROUP BY 1) SELECT CASE WHEN n < 60 THEN 'OTHER' ELSE grp::VARCHAR END AS grp, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def merge_small_groups(spark, d):
    return groups.merge_small_groups(tables.plain_units(spark, d), 60).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("class_distribution", "WITH c AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 6) AS fraction, round(100 * n / sum(n) OVER (), 6) AS percent, round(max(n) OVER () / n, 6) AS imbalance FROM c")
def class_distribution(spark, d):
    return groups.class_distribution(tables.plain_units(spark, d), "segment")


@query("smallest_class_share", "SELECT round(min(n) / sum(n), 6) AS smallest FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")
def smallest_class_share(spark, d):
    return groups.smallest_class_share(tables.plain_units(spark, d), "segment")


@query("merged_left_join", """SELECT c_custkey AS c_custkey, c_nationkey::BIGINT AS c_nationkey, coalesce(c_name, 'x') AS c_name, o.n AS n_orders, round(o.t, 4) AS spend
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) o ON c_custkey = o_custkey""", 4)
def merged_left_join(spark, d):
    main = readers.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    side = readers.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend")).withColumn("c_name", F.lit("x"))
    return groups.coalesced_left_join(main, side, "c_custkey")


@query("first_row_per_key", "SELECT o_custkey, arg_min(o_orderkey, {'a': -o_totalprice, 'b': o_orderkey}) AS o_orderkey, round(max(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1", 4)
def first_row_per_key(spark, d):
    orders = readers.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return groups.first_row_per_key(orders, "o_custkey", F.col("o_totalprice") * -1, F.col("o_orderkey"))


# -- quotas -----------------------------------------------------------------


@query("quota_counts", f"WITH {quota_sql(K)} SELECT grp::BIGINT AS grp, n, c FROM quotas")
def quota_counts(spark, d):
    return quotas.quota_counts(groups.group_shares(tables.plain_units(spark, d)), K).select("grp", "n", "c")


@query("quota_counts_weighted", f"WITH {quota_sql(60, 'pi_weight')} SELECT grp::BIGINT AS grp, c FROM quotas")
def quota_counts_weighted(spark, d):
    return quotas.quota_counts(groups.group_shares(tables.plain_units(spark, d)), 60, pi="pi_weight").select("grp", "c")


GRID = (30, 50, 80, 120)
PATH = f"""{SHARES}, k AS (SELECT unnest([30, 50, 80, 120]) AS k), steps AS (SELECT grp, t, row_number() OVER (ORDER BY pi * (ln(t + 2) - ln(t + 1)) DESC, grp, t) AS place FROM shares, range(1, 120) r(t) WHERE t < n),
    path AS (SELECT k, s.grp, s.pi, s.n, (1 + (SELECT count(*) FROM steps x WHERE x.grp = s.grp AND x.place <= k - (SELECT count(*) FROM shares)))::BIGINT AS c FROM shares s, k)"""


@query("quota_path", f"WITH {PATH} SELECT k::BIGINT AS k, grp::BIGINT AS grp, round(pi, 6) AS pi, n, c FROM path")
def quota_path(spark, d):
    return quotas.quota_path(groups.group_shares(tables.plain_units(spark, d)), GRID)


@query("path_report", f"WITH {PATH}, g AS (SELECT *, (c + 1) / (k + 25) AS q, abs(c / k - pi) AS gap FROM path) SELECT k::BIGINT AS k, round(sum(pi * ln(pi / q)), 6) AS kl_floor, round(sum(gap), 6) AS l1, round(max(gap), 6) AS max_deviation, count(*) FILTER (c > 0) AS groups_hit FROM g GROUP BY k")
def path_report(spark, d):
    return quotas.path_report(quotas.quota_path(groups.group_shares(tables.plain_units(spark, d)), GRID))


@query("kl_floor", f"WITH {quota_sql(K)} SELECT round(sum(pi * ln(pi / ((c + 1) / ({K} + (SELECT count(*) FROM quotas))))), 6) AS kl FROM quotas")
def kl_floor(spark, d):
    return quotas.kl_to_counts(quotas.quota_counts(groups.group_shares(tables.plain_units(spark, d)), K))


@query("proportional_counts", f"WITH {SHARES}, b AS (SELECT grp, floor(pi * {K})::BIGINT AS f, pi * {K} - floor(pi * {K}) AS rest FROM shares), x AS (SELECT *, row_number() OVER (ORDER BY rest DESC, grp) AS place FROM b) SELECT grp::BIGINT AS grp, f + CASE WHEN place <= {K} - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END AS c FROM x")
def proportional_counts(spark, d):
    return quotas.proportional_counts(groups.group_shares(tables.plain_units(spark, d)), K).select("grp", "c")


@query("rounded_counts", f"""WITH {SHARES}, b AS (SELECT grp, greatest(floor(pi_weight * 40), 1)::BIGINT AS f, pi_weight * 40 - floor(pi_weight * 40) AS rest FROM shares), o AS (SELECT 40 - sum(f) AS off FROM b),
    x AS (SELECT *, row_number() OVER (ORDER BY rest DESC, grp) AS up, row_number() OVER (ORDER BY rest, grp) AS down FROM b) SELECT grp::BIGINT AS grp, (f + CASE WHEN off > 0 AND up <= off THEN 1 WHEN off < 0 AND down <= -off THEN -1 ELSE 0 END)::BIGINT AS c FROM x, o""")
def rounded_counts(spark, d):
    return quotas.rounded_counts(groups.group_shares(tables.plain_units(spark, d)), 40, pi="pi_weight").select("grp", "c")


@query("capacity", f"WITH {SHARES} SELECT sum(n)::BIGINT AS capacity, count(*) AS lower, sum(n) >= {K} AND count(*) <= {K} AS feasible FROM shares")
def capacity(spark, d):
    return quotas.check_capacity(groups.group_shares(tables.plain_units(spark, d)), K)


@query("most_constrained", f"WITH {quota_sql(K)} SELECT grp::BIGINT AS grp, c, round(c / n, 6) AS tightness FROM quotas ORDER BY c / n DESC, quotas.grp LIMIT 5")
def most_constrained(spark, d):
    return quotas.most_constrained(quotas.quota_counts(groups.group_shares(tables.plain_units(spark, d)), K)).select("grp", "c", "tightness")


@query("uniform_sample", f"WITH {UNITS} SELECT unit_id FROM units ORDER BY {key_sql('5', 'unit_id')}, unit_id LIMIT {K}")
def uniform_sample(spark, d):
    return quotas.uniform_sample(tables.plain_units(spark, d), K, seed=5).select("unit_id")


NOISE = "-ln(-ln((('0x' || substr({key}, 1, 8))::BIGINT + 0.5) / 4294967296))"


@query("weighted_sample", f"WITH {UNITS} SELECT unit_id FROM units ORDER BY (CASE WHEN weight > 0 THEN ln(CASE WHEN weight > 0 THEN weight ELSE 1 END) ELSE -745 END) + ({NOISE.format(key=key_sql('5', 'unit_id'))}) DESC, unit_id LIMIT {K}")
def weighted_sample(spark, d):
    return quotas.uniform_sample(tables.plain_units(spark, d), K, seed=5, weight="weight").select("unit_id")


@query("quota_sample", f"WITH {SAMPLE} SELECT unit_id, grp::BIGINT AS grp FROM chosen")
def quota_sample(spark, d):
    return _selection(spark, d)[3].select("unit_id", "grp")


@query("quota_sample_weighted", f"WITH {quota_sql(K)}, o AS (SELECT u.*, row_number() OVER (PARTITION BY grp ORDER BY (CASE WHEN weight > 0 THEN ln(CASE WHEN weight > 0 THEN weight ELSE 1 END) ELSE -745 END) + ({NOISE.format(key=key_sql('9', 'unit_id'))}) DESC, unit_id) AS place FROM units u) SELECT unit_id, o.grp::BIGINT AS grp FROM o JOIN quotas q ON o.grp = q.grp WHERE place <= c")
def quota_sample_weighted(spark, d):
    units, _, wanted, _ = _selection(spark, d)
    return quotas.quota_sample(units, wanted, seed=9, weight="weight").select("unit_id", "grp")


START = f"first AS (SELECT unit_id FROM units ORDER BY {key_sql('5', 'unit_id')}, unit_id LIMIT {K})"


@query("project_to_quotas", f"WITH {quota_sql(K)}, {START}, o AS (SELECT u.unit_id, u.grp, row_number() OVER (PARTITION BY u.grp ORDER BY u.unit_id IN (SELECT unit_id FROM first) DESC, {key_sql('2', 'u.unit_id')}, u.unit_id) AS place FROM units u) SELECT unit_id, o.grp::BIGINT AS grp FROM o JOIN quotas q ON o.grp = q.grp WHERE place <= c")
def project_to_quotas(spark, d):
    units, _, wanted, _ = _selection(spark, d)
    return quotas.project_to_quotas(units, quotas.uniform_sample(units, K, seed=5), wanted, seed=2)


@query("project_to_size", f"WITH {SAMPLE}, o AS (SELECT unit_id FROM units u ORDER BY unit_id NOT IN (SELECT unit_id FROM chosen), {key_sql('2', 'unit_id')}, unit_id LIMIT 130) SELECT * FROM o")
def project_to_size(spark, d):
    units, _, _, chosen = _selection(spark, d)
    return quotas.project_to_size(units, chosen, 130, seed=2)


@query("quota_satisfaction", f"WITH {quota_sql(K)}, {START}, g AS (SELECT q.grp, coalesce(n1, 0) - c AS gap FROM quotas q LEFT JOIN (SELECT grp, count(*) AS n1 FROM units WHERE unit_id IN (SELECT unit_id FROM first) GROUP BY 1) x ON x.grp = q.grp) SELECT count(*) FILTER (gap <> 0) = 0 AS satisfied, sum(abs(gap))::BIGINT AS deviation, count(*) FILTER (gap <> 0) AS violations FROM g")
def quota_satisfaction(spark, d):
    units, _, wanted, _ = _selection(spark, d)
    return quotas.quota_satisfaction(units, quotas.uniform_sample(units, K, seed=5), wanted)


SUBSET = f"{SHARES}, {START}, c AS (SELECT s.grp, s.n, s.pi, s.pi_weight, count(u.unit_id) AS c, coalesce(sum(u.weight), 0) AS w FROM shares s LEFT JOIN (SELECT * FROM units WHERE unit_id IN (SELECT unit_id FROM first)) u ON u.grp = s.grp GROUP BY ALL)"


@query("group_diagnostics", f"""WITH {SUBSET}, x AS (SELECT *, sum(c) OVER () AS k, count(*) OVER () AS g FROM c) SELECT round(max(k), 6)::DOUBLE AS k, round(sum(pi * ln(pi / ((c + 1) / (k + g)))), 6) AS kl, round(sum(abs(c / k - pi)), 6) AS l1, round(max(abs(c / k - pi)), 6) AS max_deviation,
    round(-sum(CASE WHEN c > 0 THEN c / k * ln(CASE WHEN c > 0 THEN c / k ELSE 1 END) ELSE 0 END), 6) AS entropy, round(sum((c / k) * (c / k)), 6) AS concentration, count(*) FILTER (c > 0) AS groups_hit FROM x""")
def group_diagnostics(spark, d):
    units, shares, _, _ = _selection(spark, d)
    return quotas.group_diagnostics(units, quotas.uniform_sample(units, K, seed=5), shares)


@query("group_diagnostics_weighted", f"""WITH {SUBSET}, x AS (SELECT *, sum(w) OVER () AS k, count(*) OVER () AS g FROM c) SELECT round(sum(CASE WHEN pi_weight > 0 THEN pi_weight * ln(pi_weight / ((w + 1) / (k + g))) ELSE 0 END), 6) AS kl, round(sum(abs(w / k - pi_weight)), 6) AS l1, round(max(abs(w / k - pi_weight)), 6) AS max_deviation FROM x""")
def group_diagnostics_weighted(spark, d):
    units, shares, _, _ = _selection(spark, d)
    return quotas.group_diagnostics(units, quotas.uniform_sample(units, K, seed=5), shares, weight="weight").select("kl", "l1", "max_deviation")


@query("coverage_report", f"WITH {SUBSET}, x AS (SELECT *, sum(c) OVER () AS k FROM c) SELECT grp::BIGINT AS grp, n, c AS chosen, round(pi, 6) AS pi, round(c / k, 6) AS share, round(c / k / pi, 6) AS ratio FROM x")
def coverage_report(spark, d):
    units, shares, _, _ = _selection(spark, d)
    return quotas.coverage_report(units, quotas.uniform_sample(units, K, seed=5), shares)


CANDIDATES = f"{SHARES}, d AS (SELECT c.range AS candidate, unit_id, grp, row_number() OVER (PARTITION BY c.range ORDER BY {key_sql('1', 'c.range', 'unit_id')}, unit_id) AS place FROM range(40) c, units), cand AS (SELECT * FROM d WHERE place <= 30), cc AS (SELECT x.candidate, s.grp, s.pi, count(u.unit_id) AS c FROM (SELECT range AS candidate FROM range(40)) x CROSS JOIN shares s LEFT JOIN cand u ON u.candidate = x.candidate AND u.grp = s.grp GROUP BY ALL), ckl AS (SELECT candidate, sum(pi * ln(pi / ((c + 1) / (30 + 25)))) AS kl FROM cc GROUP BY 1)"


@query("random_candidates", f"WITH {CANDIDATES} SELECT candidate, unit_id FROM cand")
def random_candidates(spark, d):
    return quotas.random_candidates(tables.plain_units(spark, d), 40, 30, seed=1)


@query("total_violation", f"WITH {CANDIDATES} SELECT candidate, round(greatest(kl - 0.3, 0), 6) AS violation, kl <= 0.3 AS feasible FROM ckl")
def total_violation(spark, d):
    units = tables.plain_units(spark, d)
    return quotas.total_violation(units, quotas.random_candidates(units, 40, 30, seed=1), groups.group_shares(units), {"count": 0.3})


@query("limit_range", f"WITH {CANDIDATES} SELECT round(min(kl), 6) AS min, round(quantile_cont(kl, 0.05), 6) AS p05, round(quantile_cont(kl, 0.25), 6) AS p25, round(quantile_cont(kl, 0.5), 6) AS median, round(quantile_cont(kl, 0.75), 6) AS p75, round(quantile_cont(kl, 0.95), 6) AS p95, round(max(kl), 6) AS max FROM ckl")
def limit_range(spark, d):
    units = tables.plain_units(spark, d)
    return quotas.limit_range(units, groups.group_shares(units), 30, 40, seed=1)


@query("limit_sweep", f"WITH {CANDIDATES} SELECT tau, round(avg(CASE WHEN kl <= tau THEN 1.0 ELSE 0.0 END), 6) AS feasible_share FROM ckl, (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE]) AS tau) GROUP BY tau")
def limit_sweep(spark, d):
    units = tables.plain_units(spark, d)
    return quotas.limit_sweep(units, groups.group_shares(units), 30, (0.2, 0.3, 0.4), 40, seed=1)


# -- scalars ----------------------------------------------------------------


@query("clean_numbers", "SELECT p_partkey, round(p_retailprice, 2) AS price FROM part", 2)
def clean_numbers(spark, d):
    text = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    return readers.table(spark, d, "part").select("p_partkey", scalars.decimal_comma(text).alias("price"))


@query("clean_keys", "SELECT c_custkey AS unit_id, c_custkey AS from_name, -1::BIGINT AS from_blank FROM customer")
def clean_keys(spark, d):
    return readers.table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), scalars.digits_id(F.col("c_name")).alias("from_name"), scalars.digits_id(F.lit(" - ")).alias("from_blank"))


@query("period_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS by_slash, strftime(o_orderdate, '%Y%m') AS by_dash, strftime(o_orderdate, '%Y%m') AS by_word, '_' || ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(o_orderdate)] || year(o_orderdate) AS suffix, '202001' AS unknown FROM orders")
def period_month(spark, d):
    word = F.concat(F.element_at(F.array(*(F.lit(m.upper()) for m in scalars.MONTHS)), F.month("o_orderdate")), F.lit("/"), F.year("o_orderdate"))
    return readers.table(spark, d, "orders").select(
        "o_orderkey", scalars.period_month(F.concat(F.month("o_orderdate"), F.lit("/"), F.year("o_orderdate"))).alias("by_slash"), scalars.period_month(F.date_format("o_orderdate", "yyyy-MM")).alias("by_dash"),
        scalars.period_month(word).alias("by_word"), scalars.period_suffix(word).alias("suffix"), scalars.period_month(F.col("o_orderpriority")).alias("unknown"),
    )


@query("region_code", "SELECT n_nationkey::BIGINT AS n_nationkey, left(upper(trim(n_name)), 2) AS code, 'SP' AS named FROM nation")
def region_code(spark, d):
    return readers.table(spark, d, "nation").select("n_nationkey", scalars.region_code(F.col("n_name")).alias("code"), scalars.region_code(F.lit(" sao paulo ")).alias("named"))


@query("stable_hash", f"SELECT c_custkey AS unit_id, ('0x' || substr(md5(c_name), 1, 15))::BIGINT % 1000 AS bucket, round((('0x' || substr({key_sql('4', 'c_custkey')}, 1, 8))::BIGINT + 0.5) / 4294967296, 9) AS u FROM customer", 9)
def stable_hash(spark, d):
    return readers.table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), scalars.stable_hash(F.col("c_name"), 1000).alias("bucket"), scalars.uniform(4, F.col("c_custkey")).alias("u"))


@query("formatted", "SELECT c_mktsegment AS segment, printf('%.2f ± %.2f', avg(c_acctbal), stddev_samp(c_acctbal)) AS shown, printf('%.3f', avg(c_acctbal)) AS mean, '---' AS missing FROM customer GROUP BY 1")
def formatted(spark, d):
    return readers.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        scalars.mean_and_spread(F.avg("c_acctbal"), F.stddev_samp("c_acctbal"), 2).alias("shown"), scalars.shown(F.avg("c_acctbal"), 3).alias("mean"), scalars.shown(F.lit(float("nan"))).alias("missing")
    )


# -- preparation ------------------------------------------------------------


@query("column_roles", """SELECT * FROM (VALUES ('unit_id', 'ignore'), ('grp', 'categorical'), ('weight', 'numeric'), ('balance', 'numeric'), ('segment', 'categorical'), ('y_true', 'target'), ('pct_urbano', 'target'), ('amount', 'numeric')) t("column", role)""")
def column_roles(spark, d):
    frame = tables.plain_units(spark, d).withColumns({"y_true": F.col("balance"), "pct_urbano": F.col("balance"), "amount": F.col("balance").cast("string")})
    return spark.createDataFrame(list(prepare.infer_roles(frame).of.items()), "column string, role string")


SPLIT = f"{UNITS}, sp AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {key_sql('11', 'unit_id')}, unit_id) AS place, count(*) OVER (PARTITION BY grp) AS gn FROM units), st AS (SELECT *, place <= ceil(0.2 * gn - 1e-9) AS is_test, NOT place <= ceil(0.2 * gn - 1e-9) AS is_train FROM sp)"


@query("stratified_split", f"WITH {SPLIT} SELECT unit_id, is_test FROM st")
def stratified_split(spark, d):
    return prepare.stratified_split(tables.plain_units(spark, d), 0.2, seed=11).select("unit_id", "is_test")


@query("split_within_groups", f"""WITH {SAMPLE}, e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {key_sql('6', 'unit_id')}, unit_id) AS p2, count(*) OVER (PARTITION BY grp) AS gn FROM chosen) SELECT unit_id, p2 <= greatest(1, least(floor(0.8 * gn + 1e-9), greatest(gn - 1, 1))) AS is_train FROM e""")
def split_within_groups(spark, d):
    units, _, wanted, _ = _selection(spark, d)
    marked = prepare.sample_by_group(units, wanted, seed=7)
    return prepare.split_within_groups(marked, 0.8, seed=6).where("is_eval").select("unit_id", "is_train")


@query("split_report", f"""WITH {SAMPLE}, e AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {key_sql('6', 'unit_id')}, unit_id) AS p2, count(*) OVER (PARTITION BY grp) AS gn FROM chosen), t AS (SELECT grp, gn, p2 <= greatest(1, least(floor(0.8 * gn + 1e-9), greatest(gn - 1, 1))) AS tr FROM e), g AS (SELECT grp, count(*) FILTER (tr) / count(*) AS f FROM t WHERE gn >= 2 GROUP BY 1)
    SELECT count(*) AS evaluated, count(*) FILTER (tr) AS train, count(*) FILTER (NOT tr) AS test, 0::BIGINT AS stray, round((SELECT max(abs(f - 0.8)) FROM g), 6) AS worst_gap FROM t""")
def split_report(spark, d):
    units, _, wanted, _ = _selection(spark, d)
    return prepare.split_report(prepare.split_within_groups(prepare.sample_by_group(units, wanted, seed=7), 0.8, seed=6), 0.8)


FEATURES = f"o AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend, max(o_totalprice) AS largest FROM orders GROUP BY 1), {SPLIT}, fx AS (SELECT st.*, CASE WHEN balance >= 0 THEN n_orders END AS n_orders, CASE WHEN balance >= 0 THEN spend END AS spend, largest FROM st LEFT JOIN o ON unit_id = o_custkey)"


def _features(spark, d):
    """Units with a split; those with a negative balance lack two figures."""
    known = F.col("balance") >= 0
    rows = tables.units(spark, d).withColumns({"spend": F.when(known, F.col("spend")), "n_orders": F.when(known, F.col("n_orders"))})
    return prepare.stratified_split(rows, 0.2, seed=11).withColumn("is_train", ~F.col("is_test"))


@query("imputed", f"WITH {FEATURES}, m AS (SELECT quantile_cont(spend, 0.5) AS ms, round_even(quantile_cont(n_orders, 0.5), 0) AS mo FROM fx WHERE is_train), c AS (SELECT largest_mode FROM (SELECT floor(largest / 100000) AS largest_mode, count(*) AS n FROM fx WHERE is_train AND largest IS NOT NULL GROUP BY 1) ORDER BY n DESC, largest_mode LIMIT 1) SELECT unit_id, round(coalesce(spend, ms), 4) AS spend, coalesce(n_orders, mo)::DOUBLE AS n_orders, coalesce(floor(largest / 100000), largest_mode)::DOUBLE AS band, CASE WHEN spend IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS spend__missing FROM fx, m, c", 4)
def imputed(spark, d):
    rows = _features(spark, d).withColumn("band", F.floor(F.col("largest") / 100000).cast("double"))
    roles = {"spend": prepare.NUMERIC, "n_orders": prepare.ORDINAL, "band": prepare.CATEGORICAL}
    return prepare.impute(prepare.missing_indicators(rows, roles), roles).select("unit_id", "spend", "n_orders", "band", "spend__missing")


@query("standardised", f"WITH {FEATURES}, m AS (SELECT avg(balance) AS a, stddev_pop(balance) AS s FROM fx WHERE is_train) SELECT unit_id, round((balance - a) / s, 6) AS balance FROM fx, m")
def standardised(spark, d):
    return prepare.standardise(_features(spark, d), ["balance"], "is_train").select("unit_id", "balance")


@query("prepared_features", f"""WITH {FEATURES}, i AS (SELECT *, (SELECT quantile_cont(spend, 0.5) FROM fx WHERE is_train) AS ms, (SELECT quantile_cont(n_orders, 0.5) FROM fx WHERE is_train) AS mo FROM fx), j AS (SELECT unit_id, is_train, coalesce(spend, ms) AS spend, coalesce(n_orders, mo) AS n_orders FROM i), s AS (SELECT avg(spend) AS a1, stddev_pop(spend) AS s1, avg(n_orders) AS a2, stddev_pop(n_orders) AS s2 FROM j WHERE is_train)
    SELECT unit_id, round((spend - a1) / s1, 6) AS spend, round((n_orders - a2) / s2, 6) AS n_orders FROM j, s""")
def prepared_features(spark, d):
    return prepare.prepare_features(_features(spark, d), {"spend": prepare.NUMERIC, "n_orders": prepare.NUMERIC}).select("unit_id", "spend", "n_orders")


@query("heavy_tailed", "SELECT unnest(['skewed']) AS \"column\"")
def heavy_tailed(spark, d):
    rows = _features(spark, d).withColumns({"skewed": F.exp(F.col("balance") / 700), "flag": (F.col("balance") > 0).cast("double")})
    return spark.createDataFrame([(c,) for c in prepare.heavy_tailed(rows, ["balance", "skewed", "flag"])], "column string")


@query("category_codes", "SELECT c_custkey AS unit_id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code FROM customer")
def category_codes(spark, d):
    rows = tables.plain_units(spark, d)
    return prepare.encode(rows, "segment", prepare.category_codes(rows, "segment"), "code").select("unit_id", "code")


def _bins(name: str, points: tuple[float, ...], function) -> None:
    cuts = " + ".join(f"(CASE WHEN balance > (SELECT quantile_cont(balance, {p}) FROM units) THEN 1 ELSE 0 END)" for p in points)
    query(name, f"WITH {UNITS} SELECT unit_id, ({cuts})::BIGINT AS bin FROM units")(lambda spark, d: function(tables.plain_units(spark, d), "balance", "bin").select("unit_id", "bin"))


_bins("tercile_bin", (0.3333, 0.6667), prepare.tercile_bin)
_bins("quartile_bin", (0.25, 0.5, 0.75), prepare.quartile_bin)
_bins("quintile_bin", (0.2, 0.4, 0.6, 0.8), prepare.quintile_bin)


@query("extreme_bin", f"WITH {UNITS}, q AS (SELECT quantile_cont(balance, 0.03) AS a, quantile_cont(balance, 0.5) AS b, quantile_cont(balance, 0.97) AS c FROM units) SELECT unit_id, (CASE WHEN balance <= a THEN 0 WHEN balance >= c THEN 3 WHEN balance > b THEN 2 ELSE 1 END)::BIGINT AS bin FROM units, q")
def extreme_bin(spark, d):
    return prepare.extreme_bin(tables.plain_units(spark, d), "balance", "bin").select("unit_id", "bin")


@query("derived_labels", f"WITH {UNITS}, q AS (SELECT quantile_cont(balance, 0.5) AS m, quantile_cont(balance, 0.5) FILTER (balance > 0) AS p FROM units) SELECT unit_id, (balance > m)::BIGINT AS upper, (balance >= p)::BIGINT AS upper_positive, (balance >= 1000)::BIGINT AS rich, CASE WHEN balance >= weight THEN 0 ELSE 1 END::BIGINT AS largest FROM units, q")
def derived_labels(spark, d):
    labels = (
        prepare.Label("upper", "median", ("balance",)), prepare.Label("upper_positive", "positive_median", ("balance",)), prepare.Label("rich", "threshold", ("balance",), 1000.0),
        prepare.Label("largest", "argmax", ("balance", "weight"), 0, 0.01), prepare.Label("absent", "median", ("no_such_column",)),
    )
    rows, made = prepare.derive_labels(tables.plain_units(spark, d), labels)
    return rows.select("unit_id", *made)


@query("target_pool", """WITH t AS (SELECT 'balance' AS "column", c_acctbal AS v FROM customer UNION ALL SELECT 'nation', c_nationkey FROM customer UNION ALL SELECT 'half', c_custkey % 2 FROM customer UNION ALL SELECT 'empty', NULL FROM customer), c AS (SELECT "column", v, count(*) AS n FROM t GROUP BY ALL),
    p AS (SELECT "column", sum(CASE WHEN v IS NULL THEN n ELSE 0 END) / sum(n) AS missing, count(v) AS dist, min(CASE WHEN v IS NOT NULL THEN n END) / sum(CASE WHEN v IS NOT NULL THEN n END) AS smallest FROM c GROUP BY 1)
    SELECT "column", CASE WHEN missing > 0.1 OR dist < 2 THEN 'none' WHEN dist <= 10 AND smallest >= 0.05 THEN 'classification' WHEN dist >= 20 THEN 'regression' ELSE 'none' END AS kind, round(missing, 6) AS missing, dist AS "distinct", round(smallest, 6) AS smallest FROM p""")
def target_pool(spark, d):
    rows = readers.table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2).alias("half"), F.lit(None).cast("double").alias("empty"))
    return prepare.target_pool(rows, ["balance", "nation", "half", "empty"]).select("column", "kind", "missing", "distinct", "smallest")


@query("row_means", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(100 * (l_discount + l_tax) / 2, 6) AS m FROM lineitem")
def row_means(spark, d):
    return prepare.mean_of_columns(readers.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], "m").select("l_orderkey", "l_linenumber", "m")


@query("parent_sums", "SELECT (left(l_orderkey::VARCHAR, 3))::BIGINT AS codigo_ibge, round(sum(l_quantity), 4) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY 1", 4)
def parent_sums(spark, d):
    return readers.sum_to_parent(readers.table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber"), "l_orderkey", 3)


@query("unit_load", "SELECT c_custkey AS codigo_ibge, c_name AS name, n_name AS uf, round(c_acctbal, 2) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey", 2)
def unit_load(spark, d):
    main = readers.table(spark, d, "customer").select(F.col("c_custkey").alias("codigo_ibge"), F.col("c_name").alias("name"))
    raw = readers.table(spark, d, "customer").join(F.broadcast(readers.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    meta = readers.load_metadata(raw.select(F.col("c_custkey").alias("Cod_IBGE"), F.col("n_name").alias("uf")))
    people = readers.load_population(raw.select(F.col("c_name").alias("id"), F.translate(F.format_number("c_acctbal", 2), ",.", ".,").alias("populacao")))
    return readers.load_units(main, meta, people).select("codigo_ibge", "name", "uf", "population")


# -- metrics ----------------------------------------------------------------

REG = "count(*) AS n, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2"


@query("regression_metrics", f"WITH {PREDICTIONS}, x AS (SELECT target, {REG} FROM p GROUP BY 1) SELECT target, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM x", 4)
def regression_metrics(spark, d):
    return metrics.regression_metrics(tables.predictions(spark, d), ["target"])


@query("tail_errors", f"WITH {PREDICTIONS} SELECT target, round(quantile_cont(abs(y_true - y_pred), 0.9), 4) AS p90, round(quantile_cont(abs(y_true - y_pred), 0.95), 4) AS p95, round(quantile_cont(abs(y_true - y_pred), 0.99), 4) AS p99, round(max(abs(y_true - y_pred)), 4) AS max FROM p GROUP BY 1", 4)
def tail_errors(spark, d):
    return metrics.tail_errors(tables.predictions(spark, d), ["target"])


GROUPS = f"{PREDICTIONS}, g AS (SELECT target, grp, {REG} FROM p GROUP BY ALL HAVING count(*) >= 2)"


@query("group_metrics", f"WITH {GROUPS} SELECT target, grp::BIGINT AS grp, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM g", 4)
def group_metrics(spark, d):
    return metrics.group_metrics(tables.predictions(spark, d), ["target", "grp"])


SUMMARY = "SELECT target, count(*) AS groups, round(avg(rmse), 4) AS macro_rmse, round(max(rmse), 4) AS worst_rmse, round(min(rmse), 4) AS best_rmse, round(stddev_pop(rmse), 4) AS dispersion, round(quantile_cont(rmse, 0.75) - quantile_cont(rmse, 0.25), 4) AS iqr, round(avg(mae), 4) AS macro_mae, round(avg(r2), 4) AS macro_r2 FROM g GROUP BY 1"


@query("group_summary", f"WITH {GROUPS} {SUMMARY}", 4)
def group_summary(spark, d):
    return metrics.group_summary(tables.predictions(spark, d), ["target"])


@query("downstream_report", f"""WITH {GROUPS}, a AS (SELECT target, {REG} FROM p GROUP BY 1), b AS ({SUMMARY}) SELECT target, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, groups, macro_rmse, worst_rmse, best_rmse, dispersion, iqr, macro_mae, macro_r2 FROM a JOIN b USING (target)""", 4)
def downstream_report(spark, d):
    return metrics.downstream_report(tables.predictions(spark, d)).drop("p90", "p95", "p99", "max")


@query("group_error_stability", f"WITH {GROUPS} SELECT target, round(max(rmse), 4) AS worst, round(stddev_pop(rmse), 4) AS spread, round(avg(rmse), 4) AS mean FROM g GROUP BY 1", 4)
def group_error_stability(spark, d):
    return metrics.group_error_stability(tables.predictions(spark, d), ["target"])


@query("confusion", "WITH l AS (SELECT quality AS v FROM labels UNION SELECT toxic FROM labels) SELECT a.v::BIGINT AS y_true, b.v::BIGINT AS y_pred, (SELECT count(*) FROM labels WHERE quality = a.v AND toxic = b.v) AS n FROM l a, l b")
def confusion(spark, d):
    return metrics.confusion(tables.label_pairs(spark, d))


CLASSES = "l AS (SELECT quality AS v FROM labels UNION SELECT toxic FROM labels), c AS (SELECT v AS label, (SELECT count(*) FROM labels WHERE quality = v) AS support, (SELECT count(*) FROM labels WHERE toxic = v) AS predicted, (SELECT count(*) FROM labels WHERE quality = v AND toxic = v) AS hits FROM l), e AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM c), x AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM e)"


@query("class_metrics", f"WITH {CLASSES} SELECT label::BIGINT AS label, support, predicted, hits, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM x")
def class_metrics(spark, d):
    return metrics.class_metrics(tables.label_pairs(spark, d))


@query("classification_metrics", f"""WITH {CLASSES}, t AS (SELECT sum(support) AS n, sum(hits) / sum(support) AS po, sum(support * predicted) / (sum(support) * sum(support)) AS pe FROM x)
    SELECT n::BIGINT AS n, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa, round((SELECT avg(precision) FROM x), 6) AS macro_precision, round((SELECT avg(recall) FROM x), 6) AS macro_recall, round((SELECT avg(f1) FROM x), 6) AS macro_f1, round((SELECT sum(f1 * support) / sum(support) FROM x), 6) AS weighted_f1, round((SELECT avg(recall) FROM x WHERE support > 0), 6) AS balanced_accuracy FROM t""")
def classification_metrics(spark, d):
    return metrics.classification_metrics(tables.label_pairs(spark, d))


NATIONS = "n AS (SELECT c_nationkey AS grp, round(avg(c_acctbal), 6) AS a, round(avg(o_totalprice), 6) AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)"


def _nations(spark, d):
    joined = readers.table(spark, d, "customer").join(readers.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("grp")).agg(F.round(F.avg("c_acctbal"), 6).alias("a"), F.round(F.avg("o_totalprice"), 6).alias("b"))


@query("spearman", f"WITH {NATIONS}, k AS (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM n) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k")
def spearman(spark, d):
    return metrics.spearman(_nations(spark, d), "a", "b")


@query("kendall", f"WITH {NATIONS} SELECT round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6)::DOUBLE AS tau FROM n x, n y WHERE x.grp < y.grp")
def kendall(spark, d):
    return metrics.kendall(_nations(spark, d), "a", "b", "grp")


DRIFT = f"{SAMPLE}, dr AS (SELECT grp, avg(balance) AS f, avg(balance) FILTER (unit_id IN (SELECT unit_id FROM chosen)) AS s FROM units GROUP BY 1)"


@query("group_drift", f'WITH {DRIFT} SELECT grp::BIGINT AS grp, round(f, 4) AS "full", round(s, 4) AS subset, round(abs(s - f), 4) AS drift FROM dr', 4)
def group_drift(spark, d):
    units, _, _, chosen = _selection(spark, d)
    return metrics.group_drift(units, chosen, "balance")


@query("drift_summary", f"WITH {DRIFT} SELECT round(max(abs(s - f)), 4) AS max_drift, round(avg(abs(s - f)), 4) AS mean_drift, (SELECT round(avg(sign(x.f - y.f) * sign(x.s - y.s)), 4)::DOUBLE FROM dr x, dr y WHERE x.grp < y.grp) AS tau FROM dr", 4)
def drift_summary(spark, d):
    units, _, _, chosen = _selection(spark, d)
    return metrics.drift_summary(units, chosen, "balance")


@query("drift_matrix", f"WITH {SAMPLE} SELECT grp::BIGINT AS grp, round(abs(avg(balance) FILTER (unit_id IN (SELECT unit_id FROM chosen)) - avg(balance)), 4) AS balance, round(abs(avg(weight) FILTER (unit_id IN (SELECT unit_id FROM chosen)) - avg(weight)), 4) AS weight FROM units GROUP BY 1", 4)
def drift_matrix(spark, d):
    units, _, _, chosen = _selection(spark, d)
    return metrics.drift_matrix(units, chosen, ["balance", "weight"])


# -- comparison -------------------------------------------------------------


def _means(spark, d):
    return comparison.method_means(tables.results(spark, d))


@query("method_means", f"WITH {RESULTS} SELECT method, metric, n, round(mean, 4) AS mean, round(std, 4) AS std, round(std / abs(mean), 4) AS cv FROM m", 4)
def method_means(spark, d):
    return _means(spark, d)


@query("method_spread", f"WITH {RESULTS} SELECT method, metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM r GROUP BY ALL", 4)
def method_spread(spark, d):
    return comparison.method_spread(tables.results(spark, d))


@query("rank_table", f"WITH {RESULTS}, k AS (SELECT method, metric, row_number() OVER (PARTITION BY metric ORDER BY s, method) AS rank FROM ms) SELECT *, round(avg(rank) OVER (PARTITION BY method), 6) AS average_rank FROM k")
def rank_table(spark, d):
    return comparison.rank_table(_means(spark, d))


@query("dominance", f"WITH {RESULTS} SELECT a.method, b.method AS other, bool_and(a.s <= b.s) AND bool_or(a.s < b.s) AS dominates FROM ms a JOIN ms b ON a.metric = b.metric AND a.method <> b.method GROUP BY ALL")
def dominance(spark, d):
    return comparison.dominance(_means(spark, d))


THREE = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query("effect_isolation", f"""WITH {RESULTS}, x AS (SELECT metric, max(mean) FILTER (method = '2-HIGH') AS plain, max(mean) FILTER (method = '3-MEDIUM') AS constrained, max(mean) FILTER (method = '1-URGENT') AS searched FROM m GROUP BY 1)
    SELECT metric, round(plain, 4) AS plain, round(constrained, 4) AS constrained, round(searched, 4) AS searched, round(constrained - plain, 4) AS constraint_effect, round(searched - constrained, 4) AS objective_effect, round(searched - plain, 4) AS total_effect,
    round(100 * (constrained - plain) / abs(plain), 4) AS constraint_pct, round(100 * (searched - constrained) / abs(plain), 4) AS objective_pct, round(100 * (searched - plain) / abs(plain), 4) AS total_pct FROM x""", 4)
def effect_isolation(spark, d):
    return comparison.effect_isolation(_means(spark, d), *THREE)


@query("paired_comparison", f"WITH {RESULTS} SELECT a.metric, a.method, b.method AS other, round(a.mean, 4) AS value, round(b.mean, 4) AS other_value, round(b.mean - a.mean, 4) AS delta FROM m a JOIN m b ON a.metric = b.metric WHERE (a.method, b.method) IN (('1-URGENT', '2-HIGH'), ('3-MEDIUM', '5-LOW'))", 4)
def paired_comparison(spark, d):
    return comparison.paired_comparison(_means(spark, d), {"1-URGENT": "2-HIGH", "3-MEDIUM": "5-LOW"})


@query("best_per_metric", f"WITH {RESULTS}, x AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY s, method) AS p FROM z) SELECT metric, method AS best, round(value, 4) AS value FROM x WHERE p = 1", 4)
def best_per_metric(spark, d):
    return comparison.best_per_metric(tables.results(spark, d))


@query("championship_ranks", f"WITH {BLOCKS} SELECT method, rep::BIGINT AS rep, metric, round(value, 6) AS value, round(rank, 6) AS rank, round(CASE WHEN hi - lo < 1e-15 THEN 1 ELSE (hi - s) / (hi - lo) END, 6) AS score, (rank <= 1)::BIGINT AS win, (rank <= 3)::BIGINT AS podium FROM k")
def championship_ranks(spark, d):
    return comparison.championship_ranks(tables.results(spark, d))


@query("championship", f"WITH {BLOCKS} SELECT method, count(*) AS blocks, round(avg(rank), 6) AS mean_rank, round(avg((hi - s) / (hi - lo)), 6) AS mean_score, sum((rank <= 1)::BIGINT)::BIGINT AS wins, sum((rank <= 3)::BIGINT)::BIGINT AS podiums FROM k GROUP BY 1")
def championship(spark, d):
    return comparison.championship(tables.results(spark, d))


@query("friedman", f"""WITH {BLOCKS}, t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM k GROUP BY metric, rep, rank)), a AS (SELECT count(DISTINCT method) AS m, count(DISTINCT metric || rep) AS n FROM k), q AS (SELECT sum(power(avg_rank - (m + 1) / 2, 2)) AS ss FROM (SELECT method, avg(rank) AS avg_rank FROM k GROUP BY 1), a)
    SELECT m AS methods, n AS blocks, round(12 * n / (m * (m + 1)) * ss / (1 - ties / (n * (m * m * m - m))), 4) AS chi_square, round(3.102 * sqrt(m * (m + 1) / (6 * n)), 4) AS critical_difference FROM a, q, t""", 4)
def friedman(spark, d):
    return comparison.friedman(tables.results(spark, d))


@query("head_to_head", f"WITH {BLOCKS} SELECT a.method, b.method AS other, count(*) FILTER (a.rank < b.rank) AS wins, count(*) FILTER (a.rank > b.rank) AS losses, count(*) FILTER (a.rank = b.rank) AS ties, round((count(*) FILTER (a.rank < b.rank) - count(*) FILTER (a.rank > b.rank)) / count(*), 6) AS cliffs_delta FROM k a JOIN k b ON a.metric = b.metric AND a.rep = b.rep AND a.method <> b.method GROUP BY ALL")
def head_to_head(spark, d):
    return comparison.head_to_head(tables.results(spark, d))


@query("best_of_front_mean", f"WITH {RESULTS}, x AS (SELECT metric, rep, CASE WHEN metric LIKE 'accuracy%' THEN max(value) ELSE min(value) END AS b FROM r GROUP BY metric, rep) SELECT metric, round(avg(b), 4) AS mean_best FROM x GROUP BY 1", 4)
def best_of_front_mean(spark, d):
    return comparison.best_of_front_mean(tables.results(spark, d), ["metric"])


@query("metric_family", f"WITH {RESULTS} SELECT DISTINCT metric, CASE WHEN metric LIKE 'accuracy%' THEN 'classification' ELSE 'regression' END AS family, metric LIKE 'accuracy%' AS higher FROM r")
def metric_family(spark, d):
    return tables.results(spark, d).select("metric", comparison.metric_family(F.col("metric")).alias("family"), comparison.higher_is_better(F.col("metric")).alias("higher")).distinct()


PARETO = f"{FRONT}, nd AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.candidate <> a.candidate AND b.f1 <= a.f1 AND b.f2 <= a.f2 AND b.f3 <= a.f3 AND (b.f1 < a.f1 OR b.f2 < a.f2 OR b.f3 < a.f3)))"
PARETO2 = f"{FRONT}, nd AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.candidate <> a.candidate AND b.f1 <= a.f1 AND b.f2 <= a.f2 AND (b.f1 < a.f1 OR b.f2 < a.f2)))"


def _pareto(spark, d, names=("f1", "f2", "f3")):
    return comparison.non_dominated(tables.front(spark, d), names)


@query("non_dominated", f"WITH {PARETO} SELECT candidate, round(f1, 4) AS f1, round(f2, 4) AS f2, f3 FROM nd", 4)
def non_dominated(spark, d):
    return _pareto(spark, d)


SCALED = f"{PARETO}, zz AS (SELECT *, CASE WHEN max(f1) OVER () - min(f1) OVER () < 1e-12 THEN 0 ELSE (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) END AS z1, CASE WHEN max(f2) OVER () - min(f2) OVER () < 1e-12 THEN 0 ELSE (f2 - min(f2) OVER ()) / (max(f2) OVER () - min(f2) OVER ()) END AS z2, CASE WHEN max(f3) OVER () - min(f3) OVER () < 1e-12 THEN 0 ELSE (f3 - min(f3) OVER ()) / (max(f3) OVER () - min(f3) OVER ()) END AS z3 FROM nd)"


@query("knee", f"WITH {SCALED} SELECT candidate FROM zz ORDER BY sqrt(z1 * z1 + z2 * z2 + z3 * z3), candidate LIMIT 1")
def knee(spark, d):
    return comparison.knee(_pareto(spark, d), ["f1", "f2", "f3"]).select("candidate")


@query("representatives", f"""WITH {SCALED} SELECT 'best_f1' AS role, arg_min(candidate, {{'a': f1, 'b': candidate}}) AS candidate FROM zz UNION ALL SELECT 'best_f2', arg_min(candidate, {{'a': f2, 'b': candidate}}) FROM zz UNION ALL SELECT 'best_f3', arg_min(candidate, {{'a': f3, 'b': candidate}}) FROM zz
    UNION ALL SELECT 'knee', arg_min(candidate, {{'a': sqrt(z1 * z1 + z2 * z2 + z3 * z3), 'b': candidate}}) FROM zz UNION ALL SELECT 'chebyshev', arg_min(candidate, {{'a': greatest(z1, z2, z3), 'b': candidate}}) FROM zz
    UNION ALL SELECT 'knee_f1_f2', arg_min(candidate, {{'a': sqrt(z1 * z1 + z2 * z2), 'b': candidate}}) FROM zz UNION ALL SELECT 'knee_f1_f3', arg_min(candidate, {{'a': sqrt(z1 * z1 + z3 * z3), 'b': candidate}}) FROM zz UNION ALL SELECT 'knee_f2_f3', arg_min(candidate, {{'a': sqrt(z2 * z2 + z3 * z3), 'b': candidate}}) FROM zz""")
def representatives(spark, d):
    return comparison.representatives(_pareto(spark, d), ["f1", "f2", "f3"])


@query("crowding", f"""WITH {PARETO2}, x AS (SELECT candidate, (lead(f1) OVER (ORDER BY f1, candidate) - lag(f1) OVER (ORDER BY f1, candidate)) / nullif(max(f1) OVER () - min(f1) OVER (), 0) + (lead(f2) OVER (ORDER BY f2, candidate) - lag(f2) OVER (ORDER BY f2, candidate)) / nullif(max(f2) OVER () - min(f2) OVER (), 0) AS c FROM nd) SELECT candidate, round(c, 6) AS crowding FROM x""")
def crowding(spark, d):
    return comparison.crowding(_pareto(spark, d, ("f1", "f2")), ["f1", "f2"]).select("candidate", "crowding")


@query("hypervolume", f"WITH {FRONT}, x AS (SELECT f1, f2, min(f2) OVER (ORDER BY f1, f2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f WHERE f1 <= 2000 AND f2 <= 60) SELECT round(coalesce(sum((2000 - f1) * greatest(coalesce(m, 60) - f2, 0)), 0), 4) AS hypervolume FROM x", 4)
def hypervolume(spark, d):
    return comparison.hypervolume(tables.front(spark, d), "f1", "f2", (2000.0, 60.0))


@query("hypervolume_contribution", f"WITH {PARETO2} SELECT candidate, round(greatest(coalesce(lead(f1) OVER (ORDER BY f1, candidate), 2000) - f1, 0) * greatest(coalesce(lag(f2) OVER (ORDER BY f1, candidate), 60) - f2, 0), 4) AS contribution FROM nd", 4)
def hypervolume_contribution(spark, d):
    return comparison.hypervolume_contribution(_pareto(spark, d, ("f1", "f2")), "f1", "f2", (2000.0, 60.0)).select("candidate", "contribution")


@query("front_report", f"WITH {FRONT} SELECT count(*) AS size, round(max(f1) - min(f1), 4) AS range_f1, round(max(f2) - min(f2), 4) AS range_f2, round(corr(f1, f2), 4) AS corr_f1_f2 FROM f", 4)
def front_report(spark, d):
    return comparison.front_report(tables.front(spark, d), ["f1", "f2"])


@query("power_law", "SELECT l_linestatus AS line, count(*) AS n, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 4) AS coefficient, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 4) AS exponent, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 4) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1", 4)
def power_law(spark, d):
    return comparison.power_law(readers.table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "line"), "l_quantity", "l_extendedprice", ["line"])


# -- geometry ---------------------------------------------------------------


def _chosen(spark, d):
    rows = tables.vectors(spark, d)
    return rows, quotas.uniform_sample(rows, 25, seed=3).select("unit_id")


NEAR = f"{CHOSEN}, pr AS (SELECT v.unit_id, cv.unit_id AS s, {D2.format(a='v.vec', b='cv.vec')} AS d2 FROM v, cv), nr AS (SELECT unit_id, min(d2) AS d2 FROM pr GROUP BY 1)"


@query("nearest_chosen", f"WITH {NEAR} SELECT unit_id, round(sqrt(d2), 5) AS distance FROM nr", 5)
def nearest_chosen(spark, d):
    return geometry.nearest_chosen(*_chosen(spark, d)).select("unit_id", "distance")


@query("coverage", f"WITH {NEAR} SELECT round(avg(sqrt(d2)), 5) AS mean_distance, round(max(sqrt(d2)), 5) AS k_center, round(avg(sqrt(d2)), 5) AS k_median FROM nr", 5)
def coverage(spark, d):
    return geometry.coverage(*_chosen(spark, d))


@query("diversity", f"WITH {CHOSEN}, pp AS (SELECT sqrt({D2.format(a='a.vec', b='b.vec')}) AS d FROM cv a, cv b WHERE a.unit_id < b.unit_id) SELECT round(sum(d), 4) AS total, round(min(d), 4) AS least FROM pp", 4)
def diversity(spark, d):
    return geometry.diversity(*_chosen(spark, d))


ENTRIES = f"{CHOSEN}, e AS (SELECT unit_id, unit_id IN (SELECT unit_id FROM s) AS ins, unnest(range(64)) AS i, unnest(vec) AS x FROM v)"


@query("representation_error", f"""WITH {ENTRIES}, mm AS (SELECT i, avg(x) - avg(x) FILTER (ins) AS g FROM e GROUP BY 1), cc AS (SELECT covar_samp(a.x, b.x) - covar_samp(a.x, b.x) FILTER (a.ins) AS g FROM e a JOIN e b ON a.unit_id = b.unit_id GROUP BY a.i, b.i)
    SELECT round((SELECT sqrt(sum(g * g)) FROM mm), 5) AS mean_error, round((SELECT sqrt(sum(g * g)) FROM cc), 5) AS covariance_error""", 5)
def representation_error(spark, d):
    return geometry.representation_error(*_chosen(spark, d))


@query("moments", f"WITH {ENTRIES} SELECT i::BIGINT AS i, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM e GROUP BY 1")
def moments(spark, d):
    return geometry.moments(tables.vectors(spark, d))


@query("subset_symmetric_kl", f"""WITH {ENTRIES}, g AS (SELECT i, avg(x) AS m, greatest(var_pop(x), 1e-9) AS v, avg(x) FILTER (ins) AS ms, greatest(var_pop(x) FILTER (ins), 1e-9) AS vs FROM e GROUP BY 1) SELECT round(0.5 * sum(vs / v + v / vs - 2 + (ms - m) * (ms - m) * (1 / vs + 1 / v)), 4) AS skl FROM g""", 4)
def subset_symmetric_kl(spark, d):
    return geometry.subset_symmetric_kl(*_chosen(spark, d))


SMALL = f"{VECTORS}, x AS (SELECT vec FROM v), y AS (SELECT vec FROM v ORDER BY {key_sql('8', 'unit_id')}, unit_id LIMIT 80)"


@query("mmd_exact", f"WITH {SMALL} SELECT round((SELECT avg(exp(-{D2.format(a='a.vec', b='b.vec')} / 4)) FROM x a, x b) + (SELECT avg(exp(-{D2.format(a='a.vec', b='b.vec')} / 4)) FROM y a, y b) - 2 * (SELECT avg(exp(-{D2.format(a='a.vec', b='b.vec')} / 4)) FROM x a, y b), 6) AS mmd2")
def mmd_exact(spark, d):
    rows = tables.vectors(spark, d)
    return geometry.mmd_exact(rows, quotas.uniform_sample(rows, 80, seed=8), 2.0)


@query("median_squared_distance", f"WITH {VECTORS}, x AS (SELECT unit_id, vec FROM v ORDER BY {key_sql('0', 'unit_id')}, unit_id LIMIT 2048) SELECT round(quantile_cont({D2.format(a='a.vec', b='b.vec')}, 0.5), 5) AS median FROM x a, x b WHERE a.unit_id < b.unit_id", 5)
def median_squared_distance(spark, d):
    return spark.createDataFrame([(geometry.median_squared_distance(tables.vectors(spark, d)),)], "median double")


@query("nearest_neighbours", f"WITH {NEAR}, k AS (SELECT unit_id, s AS neighbour, row_number() OVER (PARTITION BY unit_id ORDER BY round(sqrt(d2), 9), s) AS place FROM pr WHERE unit_id <> s) SELECT unit_id, neighbour, place FROM k WHERE place <= 3")
def nearest_neighbours(spark, d):
    rows, chosen = _chosen(spark, d)
    return geometry.nearest_neighbours(rows, geometry.chosen_vectors(rows, chosen), 3).select("unit_id", "neighbour", "place")


@query("knn_predict", f"WITH {NEAR}, k AS (SELECT p.unit_id, cv.grp AS y, sqrt(d2) AS d, row_number() OVER (PARTITION BY p.unit_id ORDER BY d2, s) AS place FROM pr p JOIN cv ON cv.unit_id = p.s WHERE p.unit_id <> p.s) SELECT unit_id, round(CASE WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END, 5) AS y_pred FROM k WHERE place <= 5 GROUP BY 1", 5)
def knn_predict(spark, d):
    rows, chosen = _chosen(spark, d)
    return geometry.knn_predict(rows, geometry.chosen_vectors(rows, chosen), 5, "grp")


@query("gaussian_divergence", f"WITH {VECTORS}, m AS (SELECT * FROM v WHERE unit_id = (SELECT min(unit_id) FROM v)), q AS (SELECT v.unit_id, list_sum(list_transform(list_zip(v.vec, m.vec), lambda p: 0.5 * ((p[1] - p[2]) * (p[1] - p[2])) * 2 / 0.5)) AS d FROM v, m) SELECT unit_id, round(d, 5) AS skl FROM q", 5)
def gaussian_divergence(spark, d):
    rows = tables.vectors(spark, d)
    first = F.broadcast(rows.orderBy("unit_id").limit(1).select(F.col("vec").alias("_m")))  # one row
    flat = F.transform("vec", lambda x: F.lit(0.5))
    return rows.crossJoin(first).select("unit_id", vec.symmetric_kl_gaussians(F.col("vec"), flat, F.col("_m"), flat).alias("skl"))


# -- panel ------------------------------------------------------------------

PANEL = "p AS (SELECT event_id, user_id AS entity, ts AS time, value FROM events)"


@query("lagged", f"WITH {PANEL}, x AS (SELECT *, lag(value) OVER w AS l1, lag(value, 2) OVER w AS l2, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY entity ORDER BY time, event_id)) SELECT event_id, round(value, 6) AS value, round(l1, 6) AS value_lag1, round(l2, 6) AS value_lag2 FROM x WHERE n > 2")
def lagged(spark, d):
    return panel.lagged(tables.panel(spark, d), ["value"], 2, tie="event_id").select("event_id", "value", "value_lag1", "value_lag2")


@query("entity_means", f"WITH {PANEL} SELECT entity, round(avg(value), 6) AS value FROM p GROUP BY 1 UNION ALL SELECT NULL, round(avg(value), 6) FROM p")
def entity_means(spark, d):
    return panel.entity_means(tables.panel(spark, d), ["value"]).select("entity", "value")


@query("demeaned", f"WITH {PANEL}, tr AS (SELECT * FROM p WHERE entity % 3 <> 0), e AS (SELECT entity, avg(value) AS m FROM tr GROUP BY 1) SELECT event_id, round(value - coalesce(m, (SELECT avg(value) FROM tr)), 6) AS inner_value, round(value, 6) AS back FROM p LEFT JOIN e USING (entity)")
def demeaned(spark, d):
    rows = tables.panel(spark, d).select("event_id", "entity", "value")
    means = panel.entity_means(rows.where("entity % 3 <> 0"), ["value"])
    inner = panel.demean(rows, means, ["value"])
    back = panel.reinflate(inner, means, ["value"]).select("event_id", F.col("value").alias("back"))
    return inner.select("event_id", F.col("value").alias("inner_value")).join(back, "event_id")


@query("panel_ols", f"WITH {PANEL}, x AS (SELECT event_id, value AS y, lag(value) OVER (PARTITION BY entity ORDER BY time, event_id) AS l FROM p), t AS (SELECT regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM x) SELECT count(*) AS n, round(sqrt(avg((y - a - b * l) * (y - a - b * l))), 4) AS rmse, round(avg(abs(y - a - b * l)), 4) AS mae FROM x, t WHERE l IS NOT NULL", 4)
def panel_ols(spark, d):
    rows = panel.lagged(tables.panel(spark, d), ["value"], 1, tie="event_id")
    return panel.evaluate_panel(rows, rows, ["value_lag1"], "value", ["ols"]).select("n", "rmse", "mae")


# -- reports ----------------------------------------------------------------


@query("table_summary", """WITH t AS (SELECT 'c_acctbal' AS "column", c_acctbal AS v FROM customer UNION ALL SELECT 'c_custkey', c_custkey FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey FROM customer)
    SELECT "column", count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most FROM t GROUP BY 1""", 4)
def table_summary(spark, d):
    return reports.table_summary(readers.table(spark, d, "customer"))


@query("chained_units", """WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), m AS (SELECT quantile_cont(n_orders, 0.5) AS m FROM customer LEFT JOIN o ON c_custkey = o_custkey) SELECT c_custkey, coalesce(n_orders, m)::DOUBLE AS n_orders FROM customer LEFT JOIN o ON c_custkey = o_custkey, m""")
def chained_units(spark, d):
    main = readers.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    orders = readers.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return reports.chained_units(main, [orders], "c_custkey", "c_mktsegment").select("c_custkey", "n_orders")


@query("summary_by_run", f"WITH {RESULTS} SELECT rep::BIGINT AS rep, metric, round_even(avg(value), 4) AS value FROM r GROUP BY ALL", 4)
def summary_by_run(spark, d):
    return reports.summary_by(tables.results(spark, d), ["rep"])


@query("least_by_run", f"WITH {RESULTS} SELECT rep::BIGINT AS rep, metric, round_even(min(value), 4) AS value FROM r GROUP BY ALL", 4)
def least_by_run(spark, d):
    return reports.summary_by(tables.results(spark, d), ["rep"], "min")


@query("metric_table", f"WITH {RESULTS} SELECT method, round(avg(value) FILTER (metric = 'rmse_price'), 4) AS rmse_price, round(avg(value) FILTER (metric = 'accuracy_open'), 4) AS accuracy_open FROM r GROUP BY 1", 4)
def metric_table(spark, d):
    return reports.metric_table(tables.results(spark, d), ["rmse_price", "accuracy_open"])


@query("mark_best", f"WITH {RESULTS} SELECT method, rep::BIGINT AS rep, metric, s = min(s) OVER (PARTITION BY metric, rep) AS best FROM z")
def mark_best(spark, d):
    return reports.mark_best(tables.results(spark, d), ["metric", "rep"]).select("method", "rep", "metric", "best")


@query("out_of_bounds", f"WITH {RESULTS} SELECT metric, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most FROM r WHERE metric LIKE 'accuracy%' AND value * 2 > 1 GROUP BY 1", 4)
def out_of_bounds(spark, d):
    return reports.out_of_bounds(tables.results(spark, d), [("accuracy", 0.0, 0.5), ("rmse", 0.0, None)])


@query("wide_targets", f"WITH {RESULTS} SELECT concat(method, '|', rep) AS unit_id, round(max(value) FILTER (metric = 'rmse_price'), 4) AS rmse_price, round(max(value) FILTER (metric = 'mae_price'), 4) AS mae_price FROM r GROUP BY 1", 4)
def wide_targets(spark, d):
    long = tables.results(spark, d).select(F.concat_ws("|", "method", "rep").alias("unit_id"), F.col("metric").alias("target"), "value")
    return targets.wide_targets(long, ["rmse_price", "mae_price"])


@query("coverage_targets", "SELECT l_orderkey * 10 + l_linenumber AS unit_id, round(100 * (l_discount + l_tax) / 2, 6) AS \"cov_area_4G\", round(100 * l_tax, 6) AS \"cov_area_5G\", round(100 * ((l_discount + l_tax) / 2 + l_tax) / 2, 6) AS \"cov_area_4G_5G\", round(100 * ((l_discount + l_tax) / 2 + l_tax) / 2, 6) AS cov_area_all FROM lineitem")
def coverage_targets(spark, d):
    start = "cov_pct_area_coberta__tec_"
    rows = readers.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.col("l_discount").alias(f"{start}4g__op_a__2025_09"), F.col("l_tax").alias(f"{start}4g__op_b__2025_09"),
        F.lit(9.0).alias(f"{start}4g__op_todas__2025_09"), F.col("l_tax").alias(f"{start}5g__op_a__2025_09"), F.lit(5.0).alias(f"{start}5g__op_a__2024_01"),
    )
    return targets.coverage_targets(rows, "2025-09")
