"""Scalar column functions: number, key, period and region cleaning, formatting, portable randomness.

All are built-in expressions, so they stay inside generated code and need no
Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations and region names of the input files.
MONTHS = {"jan": "01", "fev": "02", "mar": "03", "abr": "04", "mai": "05", "jun": "06", "jul": "07", "ago": "08", "set": "09", "out": "10", "nov": "11", "dez": "12"}
REGIONS = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE", "DISTRITO FEDERAL": "DF", "ESPIRITO SANTO": "ES", "GOIAS": "GO", "MARANHAO": "MA",
    "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG", "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR", "PERNAMBUCO": "PE", "PIAUI": "PI", "RIO DE JANEIRO": "RJ",
    "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC", "SAO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def finite(value: Column) -> Column:
    """``value`` as a double, with NaN and both infinities made null: the one missing value."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def decimal_comma(text: Column) -> Column:
    """``1.234,56`` as a number; null for blanks, dashes, ``nan``, ``null`` and anything else that is none."""
    bare = F.lower(F.trim(text))
    number = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~bare.isin("", "nan", "null", "-"), number.try_cast("double"))


def digits_id(value: Column) -> Column:
    """The digits of a key as a long; -1 where there is none."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"\D", "").try_cast("bigint"), F.lit(-1).cast("long"))


def period_month(period: Column) -> Column:
    """``yyyymm`` of ``mon/yyyy``, ``m/yyyy`` or ``yyyymm`` (also with a dash); 202001 for anything else."""
    text = F.lower(F.trim(period))
    word = r"^([a-z]{3})[\s/\-](\d{4})"
    number = r"^(\d{1,2})[\s/\-](\d{4})"
    plain = r"^(\d{4})-?(\d{2})"
    month = F.coalesce(F.try_element_at(_lookup(MONTHS), F.regexp_extract(text, word, 1)), F.lit("01"))
    return (
        F.when(text.rlike(word), F.concat(F.regexp_extract(text, word, 2), month))
        .when(text.rlike(number), F.concat(F.regexp_extract(text, number, 2), F.lpad(F.regexp_extract(text, number, 1), 2, "0")))
        .when(text.rlike(plain), F.concat(F.regexp_extract(text, plain, 1), F.regexp_extract(text, plain, 2)))
        .otherwise(F.lit("202001"))
    )


def period_suffix(period: Column) -> Column:
    """``_monyyyy`` of ``mon/yyyy``; ``_unknown`` for anything else."""
    text = F.lower(F.trim(period))
    word = r"^([a-z]{3})[\s/\-](\d{4})"
    return F.when(text.rlike(word), F.concat(F.lit("_"), F.regexp_extract(text, word, 1), F.regexp_extract(text, word, 2))).otherwise(F.lit("_unknown"))


def region_code(name: Column) -> Column:
    """A two-letter region code: codes stay, known names map, of others the first two letters."""
    text = F.upper(F.trim(name))
    return F.when(F.length(text) == 2, text).otherwise(F.coalesce(F.try_element_at(_lookup(REGIONS), text), F.left(text, F.lit(2))))


def stable_hash(text: Column, modulus: int = 2**31 - 1) -> Column:
    """A whole number in [0, modulus) that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % modulus


def shuffle_key(seed: int | str, *keys: Column) -> Column:
    """A text whose order is a random order of the rows, the same in every engine and on every cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of ``shuffle_key``."""
    return (F.conv(F.substring(shuffle_key(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def gumbel(seed: int | str, *keys: Column) -> Column:
    """Standard Gumbel noise: the k largest of ln(weight) + noise are a weighted draw without replacement."""
    return -F.log(-F.log(uniform(seed, *keys)))


def mean_and_spread(mean: Column, spread: Column, digits: int = 3) -> Column:
    """``mean ± spread``; ``---`` where either is missing."""
    form = f"%.{digits}f ± %.{digits}f"
    return F.when(finite(mean).isNotNull() & finite(spread).isNotNull(), F.format_string(form, mean.cast("double"), spread.cast("double"))).otherwise(F.lit("---"))


def shown(value: Column, digits: int = 4, scientific: bool = False) -> Column:
    """A number as text; ``---`` where it is missing."""
    form = f"%.{digits}{'e' if scientific else 'f'}"
    return F.when(finite(value).isNotNull(), F.format_string(form, value.cast("double"))).otherwise(F.lit("---"))
