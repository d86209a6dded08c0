"""Scans: CSV from folders and ZIP archives, Parquet, result folders, synthetic units, and the registered tables."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decimal_comma, digits_id, region_code
from ..operators.groups import coalesced_left_join, first_row_per_key
from ..operators.prepare import resolve_column
from ..shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- files ----------------------------------------------------------------


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files right under ``folder``, in any store that the engine reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)  # noqa: SLF001
    return sorted(str(s.getPath()) for s in found if s.isFile())


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve_file(names: Sequence[str], wanted: str, alternates: Sequence[str] = ()) -> str | None:
    """The path among ``names`` for ``wanted`` or an alternate: exact name, else whatever the case, else ignoring marks, else by pattern."""
    base = {n: PurePosixPath(n).name for n in names}
    for test in (lambda b, w: b == w, lambda b, w: b.lower() == w.lower(), lambda b, w: _plain(b) == _plain(w), lambda b, w: fnmatch.fnmatch(b.lower(), w.lower())):
        for want in (wanted, *alternates):
            hits = [n for n in names if test(base[n], want)]
            if hits:
                return min(hits, key=lambda n: (len(n), n))
    return None


def read_csv(spark: SparkSession, path: str, text_only: bool = False, **options: str) -> DataFrame:
    """A CSV with a header; types are inferred unless ``text_only``."""
    return spark.read.options(header=True, inferSchema=not text_only, **options).csv(path)


def read_zipped_csv(spark: SparkSession, archive: str, member: str, schema: str, separator: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A CSV inside ZIP archives: the member by name whatever the case, the shortest path of several.

    ``archive`` may be a pattern: archives are read side by side, one member at
    a time in chunks of rows. All columns are read as text and cast by the engine.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(archive).select("content")
    names = [f.strip().rsplit(" ", 1)[0].strip("`") for f in schema.split(",")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    found = resolve_file(opened.namelist(), member)
                    if found is None:
                        raise FileNotFoundError(f"{member} in {opened.namelist()}")
                    with opened.open(found) as stream:
                        for chunk in pd.read_csv(stream, sep=separator, encoding=encoding, dtype=str, chunksize=50_000):
                            yield chunk.reindex(columns=names)

    text = files.mapInPandas(scan, ", ".join(f"`{n}` string" for n in names))
    kinds = dict(f.strip().rsplit(" ", 1) for f in schema.split(","))
    return text.select(*(F.col(n).try_cast(k).alias(n) for n, k in zip(names, kinds.values())))


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """All result files of a pattern (CSV or Parquet) as one table: a column that some lack is null there."""
    if pattern.rstrip("*").rstrip("/").endswith(".parquet") or "parquet" in pattern:
        return spark.read.option("mergeSchema", True).parquet(pattern)
    paths = [r["p"] for r in spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("p")).collect()]
    by_header: dict[tuple, list[str]] = {}
    for p in paths:  # files with the same header are one scan
        by_header.setdefault(tuple(spark.read.option("header", True).csv(p).columns), []).append(p)
    out = None
    for group in by_header.values():
        frame = spark.read.options(header=True, inferSchema=True).csv(group)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


# -- domain loaders -------------------------------------------------------


def load_metadata(raw: DataFrame, key: str = "codigo_ibge") -> DataFrame:
    """``key, longitude, latitude, uf``: columns by what their names contain, whole rows once, rows without a key left out."""
    pick = lambda *words: next((c for c in raw.columns if any(w in c.lower() for w in words)), None)
    code, lon, lat, uf = pick("cod", "ibge"), pick("lon"), pick("lat"), pick("uf", "estado", "state")
    columns = [F.col(code).try_cast("bigint").alias(key)]
    columns += [F.col(c).cast("string").try_cast("double").alias(n) for c, n in ((lon, "longitude"), (lat, "latitude")) if c]
    columns += [F.col(uf).cast("string").alias("uf")] if uf else []
    return raw.select(*columns).dropDuplicates().where(F.col(key).isNotNull())


def load_population(raw: DataFrame, id_names: Sequence[str] = ("codigo_ibge", "code", "id"), count_names: Sequence[str] = ("population", "populacao", "pop"), region_names: Sequence[str] = ("uf", "state", "estado")) -> DataFrame:
    """``codigo_ibge, population[, uf]`` from a table of texts: digits of the key, decimal commas, region codes; the first row of a key counts."""
    key, count, region = resolve_column(raw, id_names), resolve_column(raw, count_names), resolve_column(raw, region_names, required=False)
    number = decimal_comma(F.col(count)) if dict(raw.dtypes)[count] == "string" else F.col(count).cast("double")
    columns = [digits_id(F.col(key)).alias("codigo_ibge"), number.alias("population")] + ([region_code(F.col(region)).alias("uf")] if region else [])
    rows = raw.select(*columns).where("codigo_ibge >= 0")
    return first_row_per_key(rows, "codigo_ibge", F.coalesce(-F.col("population"), F.lit(float("inf"))))


def split_by_prefix(raw: DataFrame, key: str, features: Sequence[str], targets: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature, target and remaining columns by the prefixes of their names, each with the key."""
    is_target = [c for c in raw.columns if c != key and any(c.lower().startswith(p.lower()) for p in targets)]
    is_feature = [c for c in raw.columns if c != key and c not in is_target and any(c.lower().startswith(p.lower()) for p in features)]
    rest = [c for c in raw.columns if c not in (key, *is_target, *is_feature)]
    return raw.select(key, *is_feature), raw.select(key, *is_target), raw.select(key, *rest)


def sum_to_parent(rows: DataFrame, key: str, digits: int = 7, out: str = "codigo_ibge") -> DataFrame:
    """Sums of all numeric columns by the first ``digits`` of a longer code."""
    numbers = [c for c, t in rows.dtypes if c != key and t not in ("string", "boolean", "timestamp", "date")]
    return rows.groupBy(F.substring(F.col(key).cast("string"), 1, digits).try_cast("bigint").alias(out)).agg(*(F.sum(c).alias(c) for c in numbers))


def load_units(main: DataFrame, metadata: DataFrame, population: DataFrame, key: str = "codigo_ibge") -> DataFrame:
    """``main`` with metadata and population by left joins; columns that both sides have are merged, main first."""
    return coalesced_left_join(coalesced_left_join(main, metadata, key), population, key)


def synthetic_units(spark: SparkSession, rows: int, features: int = 20, groups: int = 5, seed: int = 0) -> DataFrame:
    """``unit_id, grp, weight, vec, target``: correlated Gaussian features shifted by group, and a linear target with noise."""
    base = spark.range(rows).withColumn("grp", F.concat(F.lit("S"), F.lpad((F.col("id") % groups).cast("string"), 2, "0")))
    shared = F.randn(seed)
    base = base.withColumn("_s", shared)
    noise = [F.randn(seed + 1 + j) for j in range(features)]
    base = base.withColumns({f"_f{j}": noise[j] + 0.5 * F.col("_s") + 0.3 * (F.col("id") % groups) * (1 if j % 2 else -1) for j in range(features)})
    signal = sum((F.col(f"_f{j}") * (1.0 / (j + 1)) for j in range(features)), F.lit(0.0))
    return base.select(F.col("id").alias("unit_id"), "grp", F.exp(F.randn(seed + 1001)).alias("weight"), F.array(*(F.col(f"_f{j}") for j in range(features))).alias("vec"), (signal + 0.1 * F.randn(seed + 1002)).alias("target"))
