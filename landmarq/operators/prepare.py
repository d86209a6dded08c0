"""Table preparation: column roles, splits, imputation, transforms, scaling, encoding, bins, derived labels.

Statistics are fitted on training rows alone, in one aggregation for all
columns, and applied as expressions: a fitted transform is data, not a closure.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import finite, shuffle_key, uniform

NUMERIC, ORDINAL, CATEGORICAL, IGNORE, TARGET = "numeric", "ordinal", "categorical", "ignore", "target"

# Names of columns that hold or give away a prediction target.
TARGET_PATTERNS = (
    r"^cov_area_4g$", r"^cov_area_5g$", r"^cov_hh_(4g|5g|4g_5g|all)$", r"^cov_res_(4g|5g|4g_5g|all)$", r"^cov_area_(4g_5g|all)$", r"^y_4g$", r"^y_5g$", r"^target$", r"^tx_cobertura",
    r"^indicador_principal", r"^target_", r"cobertura_area_(4g|5g)", r"^velocidade_mediana_(mean|std|median)$", r"^velocidade_mediana_agl_mean$", r"^pct_limite_mean$", r"^renda_media_(mean|std|median)$",
    r"^hhi[\s_]*(smp|scm)[\s_]*\d{4}$", r"^pct_fibra_backhaul$", r"^backhaul_fibra_\d{4}$", r"^backhaul_ano_fibra$", r"^n_prestadoras_backhaul$", r"^pct_escolas_(internet|fibra|conect_adequada)$",
    r"^densidade_.*_\d{4}$", r"^acessos_.*_\d{4}$", r"^pct_agl_alta_velocidade$", r"^pct_urbano$", r"^pct_rural$", r"^pct_cat_(low|high)_renda_(low|high)_vel$",
    r"^n_estacoes_(smp|4g|5g|2g|3g|blf|tf|geral)$", r"^n_estacoes_ativas_", r"^pct_(4g|5g)_smp$", r"^n_entidades_smp$", r"^n_tecnologias_smp$", r"^rod_pct_cob_", r"^att09_",
    r"^(isg|qf|qic|qcr)(_\w+)?_mean$", r"^n_respostas",
)
IDENTIFIERS = ("codigo_ibge", "uf", "municipio", "unit_id")


# -- columns --------------------------------------------------------------


def resolve_column(frame: DataFrame, names: Sequence[str], required: bool = True) -> str | None:
    """The first of ``names`` that ``frame`` has, by exact name and else whatever the case."""
    lower = {c.lower(): c for c in reversed(frame.columns)}
    for name in names:
        if name in frame.columns:
            return name
    for name in names:
        if name.lower() in lower:
            return lower[name.lower()]
    if required:
        raise KeyError(f"none of {list(names)} in {frame.columns}")
    return None


def numeric_columns(frame: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def castable_columns(frame: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns, and text columns whose every value is a number; one scan."""
    texts = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    bad = frame.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts)).first().asDict() if texts else {}
    numbers = set(numeric_columns(frame, exclude))
    return [c for c in frame.columns if c in numbers or bad.get(c) == 0]


def target_columns(names: Sequence[str], patterns: Sequence[str] = TARGET_PATTERNS) -> list[str]:
    found = re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE)
    return [n for n in names if found.search(n.lower())]


def drop_targets(frame: DataFrame, explicit: Sequence[str] = (), patterns: Sequence[str] = TARGET_PATTERNS) -> DataFrame:
    """``frame`` without target columns; ValueError if nothing is left."""
    gone = {*target_columns(frame.columns, patterns), *explicit}
    kept = [c for c in frame.columns if c not in gone]
    if not kept:
        raise ValueError("every column is a target")
    return frame.select(*kept)


def check_no_leakage(names: Sequence[str], patterns: Sequence[str] = TARGET_PATTERNS) -> None:
    if found := target_columns(names, patterns):
        raise ValueError(f"targets among the features: {found}")


@dataclass
class Roles:
    """The role of each column and, for categorical ones, how many values it has."""

    of: dict[str, str] = field(default_factory=dict)
    cardinality: dict[str, int] = field(default_factory=dict)

    def columns(self, role: str) -> list[str]:
        return [c for c, r in self.of.items() if r == role]

    def summary(self) -> dict[str, int]:
        return {r: len(self.columns(r)) for r in (NUMERIC, ORDINAL, CATEGORICAL, IGNORE, TARGET)}


def infer_roles(
    frame: DataFrame, categorical: Sequence[str] = (), ordinal: Sequence[str] = (), ignore: Sequence[str] = (), targets: Sequence[str] = (), low_cardinality: int | None = 25, most_categories: int | None = None,
    bool_is_category: bool = True, detect_targets: bool = True,
) -> Roles:
    """Roles by explicit lists first (target, ignore, categorical, ordinal), then identifiers, detected targets, and types.

    Text whose values are all numbers is numeric, other text categorical (ignored
    above ``most_categories``); whole numbers of at most ``low_cardinality``
    distinct values are categorical. All counts come from one scan.
    """
    detected = set(target_columns(frame.columns)) if detect_targets else set()
    roles, asked = Roles(), {}
    for f in frame.schema:
        name, lower = f.name, f.name.lower()
        if name in targets:
            roles.of[name] = TARGET
        elif name in ignore:
            roles.of[name] = IGNORE
        elif name in categorical:
            roles.of[name] = CATEGORICAL
            asked[name] = f
        elif name in ordinal:
            roles.of[name] = ORDINAL
        elif lower in IDENTIFIERS:
            roles.of[name] = IGNORE
        elif name in detected or lower.startswith("y_") or "y_cov_" in lower:
            roles.of[name] = TARGET
        elif isinstance(f.dataType, T.BooleanType):
            roles.of[name] = CATEGORICAL if bool_is_category else NUMERIC
            if bool_is_category:
                roles.cardinality[name] = 2
        elif isinstance(f.dataType, (T.StringType, T.IntegralType)):
            roles.of[name] = ""
            asked[name] = f
        else:
            roles.of[name] = NUMERIC if isinstance(f.dataType, T.NumericType) else IGNORE
    if asked:
        counts = [F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(asked)]
        words = [F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(f"w{i}") for i, c in enumerate(asked)]
        row = frame.agg(*counts, *words).first()
        for i, (name, f) in enumerate(asked.items()):
            distinct, text = row[f"d{i}"], row[f"w{i}"] > 0
            if not roles.of[name]:
                if isinstance(f.dataType, T.StringType):
                    roles.of[name] = NUMERIC if not text else IGNORE if most_categories is not None and distinct > most_categories else CATEGORICAL
                else:
                    roles.of[name] = CATEGORICAL if low_cardinality is not None and distinct <= low_cardinality else NUMERIC
            if roles.of[name] == CATEGORICAL:
                roles.cardinality[name] = distinct
    roles.of = {c: roles.of[c] for c in frame.columns}
    return roles


# -- splits ---------------------------------------------------------------


def stratified_split(units: DataFrame, fraction: float, seed: int | str = 0, group: str = "grp", flag: str = "is_test") -> DataFrame:
    """Marks ceil(fraction * n) rows of each group, at random; groups of one row go by chance alone."""
    rows = Window.partitionBy(group)
    order = rows.orderBy(shuffle_key(seed, F.col("unit_id")), "unit_id")
    n = F.count(F.lit(1)).over(rows)
    ranked = units.withColumns({"_n": n, "_rank": F.row_number().over(order)})
    held = F.when(F.col("_n") >= 2, F.col("_rank") <= F.ceil(F.lit(fraction) * F.col("_n") - 1e-9)).otherwise(uniform(f"{seed}|alone", F.col("unit_id")) < fraction)
    return ranked.withColumn(flag, held).drop("_n", "_rank")


def sample_by_group(units: DataFrame, counts: DataFrame, seed: int | str = 0, flag: str = "is_eval") -> DataFrame:
    """Marks ``c`` rows of each group of ``counts``, at random."""
    order = Window.partitionBy("grp").orderBy(shuffle_key(seed, F.col("unit_id")), "unit_id")
    target = counts.select(F.col("grp").alias("_g"), F.col("c").alias("_c"))
    ranked = units.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(target), F.col("grp").eqNullSafe(F.col("_g")), "left")
    return ranked.withColumn(flag, F.coalesce(F.col("_rank") <= F.col("_c"), F.lit(False))).drop("_rank", "_g", "_c")


def split_within_groups(units: DataFrame, train_fraction: float, seed: int | str = 0, among: str = "is_eval", flag: str = "is_train") -> DataFrame:
    """Marks floor(fraction * n) of the ``among`` rows of each group, at least one and not all of several."""
    rows = Window.partitionBy("grp", among)
    order = rows.orderBy(shuffle_key(seed, F.col("unit_id")), "unit_id")
    ranked = units.withColumns({"_n": F.count(F.lit(1)).over(rows), "_rank": F.row_number().over(order)})
    wanted = F.greatest(F.lit(1), F.least(F.floor(F.lit(train_fraction) * F.col("_n") + 1e-9), F.greatest(F.col("_n") - 1, F.lit(1))))
    return ranked.withColumn(flag, F.col(among) & (F.col("_rank") <= wanted)).drop("_n", "_rank")


def split_report(units: DataFrame, train_fraction: float, among: str = "is_eval", flag: str = "is_train") -> DataFrame:
    """One row that tells whether a split holds: sizes, stray rows, and the largest gap of a group's share."""
    groups = units.where(F.col(among)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("t"))
    gap = groups.where("n >= 2").agg(F.coalesce(F.max(F.abs(F.col("t") / F.col("n") - train_fraction)), F.lit(0.0)).alias("worst_gap"))
    sizes = units.agg(F.count_if(F.col(among)).alias("evaluated"), F.count_if(F.col(among) & F.col(flag)).alias("train"), F.count_if(F.col(among) & ~F.col(flag)).alias("test"), F.count_if(F.col(flag) & ~F.col(among)).alias("stray"))
    return sizes.crossJoin(gap)


# -- imputation and transforms --------------------------------------------


def train_medians(rows: DataFrame, columns: Sequence[str], train: str = "is_train") -> dict[str, float]:
    """The median of each column over training rows; 0 where none has a value. One exact aggregation."""
    row = rows.agg(*(F.percentile(F.when(F.col(train), finite(F.col(c))), 0.5).alias(c) for c in columns)).first()
    return {c: 0.0 if row[c] is None else row[c] for c in columns}


def train_modes(rows: DataFrame, columns: Sequence[str], train: str = "is_train") -> dict[str, float]:
    """The most frequent value of each column over training rows, the smallest of several; -1 where none has a value."""
    row = rows.agg(*(F.mode(F.when(F.col(train), finite(F.col(c))), True).alias(c) for c in columns)).first()
    return {c: -1.0 if row[c] is None else row[c] for c in columns}


def impute(rows: DataFrame, roles: Mapping[str, str], train: str = "is_train", category_strategy: str = "mode", ordinal_strategy: str = "median") -> DataFrame:
    """Fills missing and infinite values: numeric medians, ordinal medians rounded half to even (or modes), category modes (or -1)."""
    numbers = [c for c, r in roles.items() if r == NUMERIC]
    ordinals = [c for c, r in roles.items() if r == ORDINAL]
    categories = [c for c, r in roles.items() if r == CATEGORICAL]
    by_median = numbers + (ordinals if ordinal_strategy == "median" else [])
    by_mode = (categories if category_strategy == "mode" else []) + (ordinals if ordinal_strategy == "mode" else [])
    fill = (train_medians(rows, by_median, train) if by_median else {}) | (train_modes(rows, by_mode, train) if by_mode else {})
    fill |= {c: -1.0 for c in categories if c not in fill}
    for c in ordinals:
        fill[c] = float(round(fill[c]))
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in fill.items()})


def impute_all(rows: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Fills from the whole table: ``median``, ``mean`` or ``zero``."""
    if strategy == "zero":
        return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns})
    how = (lambda c: F.percentile(finite(F.col(c)), 0.5)) if strategy == "median" else (lambda c: F.avg(finite(F.col(c))))
    row = rows.agg(*(how(c).alias(c) for c in columns)).first()
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(row[c] or 0.0)) for c in columns})


def missing_indicators(rows: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Adds ``<column>__missing`` (0 or 1) for numeric and ordinal columns with any missing value that have no indicator yet."""
    columns = [c for c, r in roles.items() if r in (NUMERIC, ORDINAL) and not c.startswith("missingness_indicator_of_") and f"missingness_indicator_of_{c}" not in rows.columns]
    if not columns:
        return rows
    row = rows.agg(*(F.count_if(finite(F.col(c)).isNull()).alias(c) for c in columns)).first()
    return rows.withColumns({f"{c}__missing": finite(F.col(c)).isNull().cast("double") for c in columns if row[c]})


def heavy_tailed(rows: DataFrame, columns: Sequence[str], train: str = "is_train") -> list[str]:
    """Columns for log1p, judged on training rows: not negative, not binary, and with a far and large upper tail."""
    value = lambda c: F.when(F.col(train), F.coalesce(finite(F.col(c)), F.lit(0.0)))
    picks = [x for i, c in enumerate(columns) for x in (F.min(value(c)).alias(f"l{i}"), F.max(value(c)).alias(f"h{i}"), F.count_distinct(F.when(value(c) <= 1, value(c))).alias(f"d{i}"), F.percentile(value(c), [0.5, 0.9, 0.99]).alias(f"q{i}"))]
    row = rows.agg(*picks).first()
    out = []
    for i, c in enumerate(columns):
        low, high, distinct, quantiles = (row[f"{k}{i}"] for k in "lhdq")
        if low is None or low < 0 or high <= 1 and distinct <= 2:
            continue
        q50, q90, q99 = quantiles
        if (q99 + 1e-6) / max(q50, 1e-6) >= 25 and q99 >= 10 and q99 > q90:
            out.append(c)
    return out


def log_transform(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in columns}) if columns else rows


def standardise(rows: DataFrame, columns: Sequence[str], train: str | None = None, least: float = 1e-10) -> DataFrame:
    """z-scores by mean and population deviation (of training rows if a flag is named); a deviation below ``least`` counts as 1."""
    value = lambda c: F.when(F.col(train), F.col(c).cast("double")) if train else F.col(c).cast("double")
    row = rows.agg(*(F.avg(value(c)).alias(f"m_{c}") for c in columns), *(F.stddev_pop(value(c)).alias(f"s_{c}") for c in columns)).first()
    scale = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0.0) >= least else 1.0) for c in columns}
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def prepare_features(rows: DataFrame, roles: Mapping[str, str], train: str = "is_train") -> DataFrame:
    """Indicators, imputation, log1p of heavy tails and scaling of numeric columns, all fitted on training rows."""
    marked = missing_indicators(rows, roles)
    filled = impute(marked, roles, train)
    numbers = [c for c, r in roles.items() if r == NUMERIC]
    logged = log_transform(filled, heavy_tailed(filled, numbers, train) if numbers else [])
    return standardise(logged, numbers, train) if numbers else logged


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """``value, code``: values in order of text from 0; the map that ``encode`` applies."""
    values = rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return values.select("value", (F.dense_rank().over(Window.orderBy("value")) - 1).alias("code"))  # a row for each distinct value


def encode(rows: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """``rows`` with the code of ``column``; -1 for null and unseen values."""
    named = codes.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
    joined = rows.join(named, F.col(column).cast("string") == F.col("_v"), "left")
    return joined.withColumn(out or column, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")


# -- bins and derived labels ----------------------------------------------


def quantile_bin(rows: DataFrame, column: str, points: Sequence[float], out: str) -> DataFrame:
    """How many of the column's quantiles at ``points`` a value exceeds; missing values count as 0."""
    value = F.coalesce(finite(F.col(column)), F.lit(0.0))
    cuts = rows.agg(F.percentile(value, list(points)).alias("q")).first()["q"] or []
    return rows.withColumn(out, sum(((value > F.lit(q)).cast("int") for q in cuts), F.lit(0)))


def tercile_bin(rows: DataFrame, column: str, out: str) -> DataFrame:
    return quantile_bin(rows, column, (0.3333, 0.6667), out)


def quartile_bin(rows: DataFrame, column: str, out: str) -> DataFrame:
    return quantile_bin(rows, column, (0.25, 0.5, 0.75), out)


def quintile_bin(rows: DataFrame, column: str, out: str) -> DataFrame:
    return quantile_bin(rows, column, (0.2, 0.4, 0.6, 0.8), out)


def extreme_bin(rows: DataFrame, column: str, out: str) -> DataFrame:
    """0 up to the 3rd percentile, 3 from the 97th on, 2 above the median, else 1."""
    value = F.coalesce(finite(F.col(column)), F.lit(0.0))
    low, mid, high = rows.agg(F.percentile(value, [0.03, 0.5, 0.97]).alias("q")).first()["q"] or (0.0, 0.0, 0.0)
    return rows.withColumn(out, F.when(value <= low, 0).when(value >= high, 3).when(value > mid, 2).otherwise(1))


def median_label(rows: DataFrame, column: str, out: str, positive_only: bool = False) -> DataFrame:
    """1 above the median; with ``positive_only`` from the median of the positive values on."""
    value = F.coalesce(finite(F.col(column)), F.lit(0.0))
    middle = rows.agg(F.percentile(F.when(value > 0, value) if positive_only else value, 0.5).alias("m")).first()["m"] or 0.0
    return rows.withColumn(out, ((value >= middle) if positive_only else (value > middle)).cast("int"))


def threshold_label(rows: DataFrame, column: str, least: float, out: str) -> DataFrame:
    return rows.withColumn(out, (F.coalesce(finite(F.col(column)), F.lit(0.0)) >= least).cast("int"))


def argmax_label(rows: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """The place of the largest of ``columns``, the first of several."""
    values = F.array(*(F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns))
    return rows.withColumn(out, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


@dataclass(frozen=True)
class Label:
    """A derived class label: ``kind`` names how, ``columns`` from what; ``fallback`` is taken if a class is too small."""

    name: str
    kind: str
    columns: tuple[str, ...]
    parameter: float = 0.0
    least_share: float = 0.05
    fallback: str | None = None


# Derived labels of the municipal tables.
LABELS = (
    Label("concentrated_mobile_market", "threshold", ("HHI SMP_2024",), 0.25), Label("high_fiber_backhaul", "positive_median", ("pct_fibra_backhaul",)),
    Label("high_speed_broadband", "median", ("pct_agl_alta_velocidade",)), Label("has_5g_coverage", "direct", ("att09_any_present_5G",)), Label("urbanization_level", "tercile", ("pct_urbano",)),
    Label("broadband_speed_tier", "tercile", ("velocidade_mediana_mean",)), Label("income_tier", "tercile", ("renda_media_mean",)), Label("mobile_penetration_tier", "quartile", ("Densidade_Telefonia Móvel_2025",)),
    Label("infra_density_tier", "quintile", ("n_estacoes_smp",)), Label("road_coverage_4g_tier", "quintile", ("rod_pct_cob_todas_4g",)),
    Label("income_speed_class", "argmax", ("pct_cat_low_renda_low_vel", "pct_cat_low_renda_high_vel", "pct_cat_high_renda_low_vel", "pct_cat_high_renda_high_vel"), 0, 0.02, "halves"),
    Label("urban_rural_extremes", "extreme", ("pct_urbano",), 0, 0.02, "tercile"), Label("income_extremes", "extreme", ("renda_media_mean",), 0, 0.02, "tercile"),
    Label("speed_extremes", "extreme", ("velocidade_mediana_mean",), 0, 0.02, "tercile"), Label("pop_5g_digital_divide", "cross", ("populacao_2025", "att09_any_present_5G"), 0, 0.02, "second"),
)


def _apply_label(rows: DataFrame, kind: str, columns: Sequence[str], out: str, parameter: float) -> DataFrame:
    value = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
    if kind == "threshold":
        return threshold_label(rows, columns[0], parameter, out)
    if kind in ("median", "positive_median"):
        return median_label(rows, columns[0], out, kind == "positive_median")
    if kind == "direct":
        return rows.withColumn(out, value(columns[0]).cast("int"))
    if kind == "second":
        return rows.withColumn(out, value(columns[1]).cast("int"))
    if kind == "argmax":
        return argmax_label(rows, columns, out)
    if kind == "halves":
        half = len(columns) // 2
        return rows.withColumn(out, (sum(map(value, columns[half:])) > sum(map(value, columns[:half]))).cast("int"))
    if kind == "cross":
        marked = median_label(rows, columns[0], "_large")
        return marked.withColumn(out, F.col("_large") * 2 + value(columns[1]).cast("int")).drop("_large")
    return {"tercile": tercile_bin, "quartile": quartile_bin, "quintile": quintile_bin, "extreme": extreme_bin}[kind](rows, columns[0], out)


def _classes(rows: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, float]]:
    """How many classes each of ``names`` has (missing is one) and the share of its smallest: one count for all."""
    labelled = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(n).cast("string").alias("value")) for n in names)))
    counts = rows.select(labelled.alias("_l")).groupBy("_l.label", "_l.value").count()
    found = counts.groupBy("label").agg(F.count(F.lit(1)).alias("classes"), (F.min("count") / F.sum("count")).alias("least")).collect()  # a row for each label
    return {r["label"]: (r["classes"], r["least"]) for r in found}


def derive_labels(rows: DataFrame, labels: Sequence[Label] = LABELS) -> tuple[DataFrame, list[str]]:
    """``rows`` with every label whose columns are there and whose smallest class is large enough, and their names.

    A label that fails takes its fallback if that passes. One count of classes checks all labels, a second one all fallbacks.
    """
    present = {}
    for label in labels:
        columns = [resolve_column(rows, [c, c.replace(" ", "_")], required=False) for c in label.columns]
        if None not in columns:
            present[label.name] = (label, columns)
    made: dict[str, str] = {}
    for first in (True, False):
        kinds = {n: label.kind if first else label.fallback for n, (label, _) in present.items() if n not in made}
        kinds = {n: kind for n, kind in kinds.items() if kind is not None}
        if not kinds:
            continue
        tried = rows
        for name, kind in kinds.items():
            tried = _apply_label(tried, kind, present[name][1], name, present[name][0].parameter)
        found = _classes(tried, list(kinds))
        made |= {n: kind for n, kind in kinds.items() if n in found and found[n][0] >= 2 and found[n][1] >= present[n][0].least_share}
    for name in present:
        if name in made:
            rows = _apply_label(rows, made[name], present[name][1], name, present[name][0].parameter)
    return rows, [n for n in present if n in made]


def regression_targets(rows: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """``unit_id`` and a column for each named target, read from the first candidate column there is; missing values count as 0."""
    picks = {}
    for name, candidates in names.items():
        if column := resolve_column(rows, candidates, required=False):
            picks[name] = F.coalesce(finite(F.col(column).cast("string").try_cast("double")), F.lit(0.0)).alias(name)
    return rows.select("unit_id", *picks.values())


def mean_of_columns(rows: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """The mean of a row's values that aren't missing (0 if all are), as percentages: times 100 if no value exceeds 1.5."""
    values = F.filter(F.array(*(finite(F.col(c)) for c in columns)), lambda x: x.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)
    rows = rows.withColumn(out, mean)
    top = rows.agg(F.max(out).alias("m")).first()["m"]
    return rows.withColumn(out, F.col(out) * 100) if top is not None and top <= 1.5 else rows


def target_pool(rows: DataFrame, columns: Sequence[str], most_missing: float = 0.1, least_distinct: int = 20, most_classes: int = 10, least_class: float = 0.05, least_variance: float = 1e-10) -> DataFrame:
    """``column, kind, missing, distinct, variance, smallest``: which columns can serve as targets, and for what.

    ``regression`` needs few missing values, many distinct ones and variance;
    ``classification`` few classes with no rare one. Others are ``none``.
    """
    long = rows.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), finite(F.col(c)))))).alias("column", "value"))
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("value").isNotNull()
    total = F.sum("n")
    known = F.sum(F.when(there, F.col("n")))
    profile = counted.groupBy("column").agg(
        (F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)) / total).alias("missing"), F.count_if(there).alias("distinct"),
        (F.sum(F.when(there, F.col("n") * F.col("value") * F.col("value"))) / known - F.pow(F.sum(F.when(there, F.col("n") * F.col("value"))) / known, 2)).alias("variance"),
        (F.min(F.when(there, F.col("n"))) / known).alias("smallest"),
    )
    kind = (
        F.when((F.col("missing") > most_missing) | (F.col("distinct") < 2), "none").when((F.col("distinct") <= most_classes) & (F.col("smallest") >= least_class), "classification")
        .when((F.col("distinct") >= least_distinct) & (F.col("variance") > least_variance), "regression").otherwise("none")
    )
    return profile.withColumn("kind", kind).select("column", "kind", "missing", "distinct", "variance", "smallest")


def target_kind(rows: DataFrame, column: str, most_classes: int = 20) -> str:
    """``classification`` for text and for whole numbers of few values, else ``regression``."""
    if isinstance(rows.schema[column].dataType, (T.StringType, T.BooleanType)):
        return "classification"
    value = finite(F.col(column))
    row = rows.agg(F.count_distinct(value).alias("d"), F.coalesce(F.bool_and(value == F.round(value)), F.lit(True)).alias("whole")).first()
    return "classification" if row["whole"] and row["d"] <= most_classes else "regression"
