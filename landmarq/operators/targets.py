"""Target tables: coverage targets, families of columns that give each other away, and random sets of targets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prepare import mean_of_columns

# Name patterns of related columns, families that exclude each other, and columns that are no targets.
FAMILIES = {
    "density_blf": r"^Densidade_Banda Larga Fixa_\d{4}$", "density_movel": r"^Densidade_Telefonia M.vel_\d{4}$", "density_fixa": r"^Densidade_Telefonia Fixa_\d{4}$",
    "density_tv": r"^Densidade_TV por Assinatura_\d{4}$", "density_scm": r"^Densidade_SCM_\d{4}$", "access_blf": r"^Acessos_Banda Larga Fixa_\d{4}$", "access_movel": r"^Acessos_Telefonia M.vel_\d{4}$",
    "access_fixa": r"^Acessos_Telefonia Fixa_\d{4}$", "access_tv": r"^Acessos_TV por Assinatura_\d{4}$", "access_scm": r"^Acessos_SCM_\d{4}$", "hhi_smp": r"^HHI\s*SMP_\d{4}$", "hhi_scm": r"^HHI\s*SCM_\d{4}$",
    "speed": r"^velocidade_mediana_(mean|std|median|agl_mean)$", "income": r"^renda_media_(mean|std|median)$",
    "stations": r"^(n_estacoes_(blf|ativas_blf|tf|ativas_tf|geral|ativas_geral|smp|4g|5g|2g|3g)|pct_(4g|5g)_smp|n_entidades_smp|n_tecnologias_smp)$", "roads": r"^rod_pct_cob_", "coverage": r"^cov_pct_",
    "schools": r"^pct_escolas_(internet|fibra|conect_adequada)$", "backhaul": r"^(pct_fibra_backhaul|backhaul_fibra_\d{4}|backhaul_ano_fibra|n_prestadoras_backhaul)$", "urban": r"^pct_(urbano|rural)$",
    "survey": r"^(isg|qf|qic|qcr)(_\w+)?_mean$", "answers": r"^n_respostas(_scm|_movel)?$", "composites": r"^pct_cat_(low|high)_renda_(low|high)_vel$", "fiber": r"^ibc_indicador_fibra_", "presence": r"^att09_",
    "active": r"^pct_ativas_(blf|tf|geral)$", "cov_targets": r"^cov_(area|hh|res)_(4g|5g|4g_5g|all)$",
}
LINKED = (("density_blf", "access_blf"), ("density_movel", "access_movel"), ("density_fixa", "access_fixa"), ("density_tv", "access_tv"), ("density_scm", "access_scm"))
NO_TARGETS = (
    r"_missing$", r"Frequ[eê]ncia",
    r"^(cd_ibge|codibge|cod_ibge|municipio|uf|sigla_uf|estado|regiao|nome_municipio|latitude|longitude|populacao|pop_|area_km2|pib)",
)
COVERAGE = {"area": "area_coberta", "hh": "domicilios", "res": "populacao"}


def families(columns: Sequence[str], patterns: Mapping[str, str] = FAMILIES) -> dict[str, list[str]]:
    """The columns of each family."""
    return {name: [c for c in columns if re.search(p, c, re.IGNORECASE)] for name, p in patterns.items()}


def related_columns(target: str, columns: Sequence[str], patterns: Mapping[str, str] = FAMILIES, linked: Sequence[tuple[str, str]] = LINKED) -> list[str]:
    """Columns that would give ``target`` away: those of its families and of linked ones, itself left out.

    A binned target (``<column>__tercile``) is related to its column too.
    """
    base = target.removesuffix("__tercile")
    groups = families(columns, patterns)
    own = {n for n, members in groups.items() if base in members}
    own |= {b for a, b in (*linked, *((b, a) for a, b in linked)) if a in own}
    found = {c for n in own for c in groups.get(n, [])} | ({base} if base != target else set())
    return sorted(found - {target})


def substantive(columns: Sequence[str], patterns: Sequence[str] = NO_TARGETS) -> list[str]:
    return [c for c in columns if not any(re.search(p, c, re.IGNORECASE) for p in patterns)]


def without_related(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``rows`` without the targets and all columns related to them."""
    gone = {*targets, *(c for t in targets for c in related_columns(t, rows.columns))}
    return rows.drop(*gone)


def draw_targets(regression: Sequence[str], classification: Sequence[str], draws: int, n_regression: int, n_classification: int, seed: int = 0) -> list[tuple[list[str], list[str]]]:
    """Random sets of target names; a column serves once in a set, be it as it is or binned."""
    random, out = np.random.default_rng(seed), []
    for _ in range(draws):
        first = [regression[i] for i in random.choice(len(regression), min(n_regression, len(regression)), replace=False)] if regression else []
        left = [c for c in classification if c.removesuffix("__tercile") not in first]
        second = [left[i] for i in random.choice(len(left), min(n_classification, len(left)), replace=False)] if left else []
        out.append((sorted(first), sorted(second)))
    return out


def coverage_targets(rows: DataFrame, snapshot: str) -> DataFrame:
    """``unit_id`` and the coverage targets that the table's columns allow.

    For each kind (area, households, residents) and technology, the mean over
    operators of ``cov_pct_<kind>__tec_<technology>__op_<operator>__<snapshot>``
    (the column of all operators only if there is no other); then the mean of 4G and 5G, and of all technologies.
    """
    ending = f"__{snapshot.replace('-', '_').strip()}".lower()
    base, made = rows, {}
    for kind, word in COVERAGE.items():
        for technology in ("2g", "3g", "4g", "5g") if kind == "area" else ("4g", "5g"):
            start = f"cov_pct_{word}__tec_{technology}__op_"
            columns = [c for c in rows.columns if c.lower().startswith(start) and c.lower().endswith(ending)]
            columns = [c for c in columns if "__op_todas__" not in c.lower()] or columns
            if columns:
                name = f"cov_{kind}_{technology.upper()}"
                base = mean_of_columns(base, columns, name)
                made.setdefault(kind, []).append(name)
    out = []
    for kind, names in made.items():
        both = [n for n in names if n.endswith(("_4G", "_5G"))]
        out += [F.col(n) for n in both]
        if both:
            out.append((sum((F.col(n) for n in both), F.lit(0.0)) / len(both)).alias(f"cov_{kind}_4G_5G"))
        out.append((sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).alias(f"cov_{kind}_all"))
    return base.select("unit_id", *out)


def wide_targets(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """``unit_id`` and a column for each of ``names`` from rows ``unit_id, target, value``."""
    return long.groupBy("unit_id").pivot("target", list(names)).agg(F.first("value"))
