"""Language identification by fusing evidence the Bayesian way.

Three kinds of evidence about a row's language meet: how likely its text is
under each language's byte trigrams, what the markup declares, and what other
rows of its host (and, where a host says little, of its address suffix, and of
the whole table) are written in. The host priors come from grouped sums of the
texts' own posteriors, smoothed level by level; a row's own share is taken out of
its host's. How far a declaration is to be trusted is counted in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ._common import materialise, shielded, unshielded

#: Classes of byte trigrams.
BUCKETS = 1 << 15
#: At most so many distinct labelled texts of a language train its model, and a language needs so many labelled rows.
SAMPLE_ROWS, LEAST_ROWS = 4000, 12
#: Languages with the most labelled rows that are told apart: bounds the model at BUCKETS * LANGUAGES numbers.
LANGUAGES = 200
#: Trigrams overlap by two thirds, so each counts for a third; and a text's evidence stops growing at so many.
WEIGHT, MOST_TRIGRAMS = 1 / 3, 3000
#: Rows that a host's prior weighs as much as, for its suffix; and a suffix's, for the whole table.
HOST_SMOOTHING, SUFFIX_SMOOTHING = 8.0, 40.0
#: The class of texts that fit no language better than noise, and its prior.
UNKNOWN, UNKNOWN_PRIOR = "und", 0.01
#: Bytes up to which hosts' sums and priors are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


def trigram_classes(text: bytes | None) -> np.ndarray:
    """The class of each byte trigram of the lower-cased text, words set apart by single spaces; marks and digits count as one sign."""
    words = (text or b"").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.int64)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    mixed = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64)


def _fold() -> bytes:
    """A-Z to lower case; ASCII digits and marks to a space. Bytes of other scripts stay."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


_FOLD = _fold()


@dataclass
class TextModel:
    """Log-likelihoods of trigram classes: one row for each class, one column for each language and one for noise."""

    languages: list[str]
    table: np.ndarray

    def score(self, text: bytes | None) -> np.ndarray:
        """Log-likelihood of the text for each language and for noise; zeros without letters."""
        at = trigram_classes(text)
        total = np.zeros(self.table.shape[1])
        for i in range(0, len(at), 65536):
            total += self.table[at[i : i + 65536]].sum(axis=0, dtype=np.float64)
        if len(at):
            total *= WEIGHT * min(1.0, MOST_TRIGRAMS / len(at))
        return total


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, lower-cased; null for null or blank."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]+)", 1))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host name; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([^.]+)\.?$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    return primary(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1))


def markup_text(html: Column) -> Column:
    """Text outside scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[a-zA-Z]+;|&#\d+;", " ")


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel | None:
    """A text model from rows ``text, declared`` with a declaration; None if no language has enough.

    Each language is trained on its distinct texts with the least hash, ``sample_rows`` at most: a
    sample that is bounded, is never empty, hangs neither on the order of the rows nor on how often a text repeats.
    Whole texts count. Counts come from one grouped sum; what reaches the driver is a number for each language and class.
    Of languages with ``LEAST_ROWS`` rows the ``LANGUAGES`` with the most have a model; for others see ``identify``.
    """
    ship(rows.sparkSession)
    given = rows.where("declared is not null").select(F.coalesce("text", F.lit("")).alias("text"), "declared").withColumn("hash", F.xxhash64("text", F.lit(7)))
    found = given.groupBy("declared").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("texts")).where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "declared").limit(LANGUAGES).collect()
    if not found:
        return None
    languages = sorted(r["declared"] for r in found)
    # Hashes of distinct texts are uniform, so a threshold leaves about twice the wanted number of them to be ranked.
    share = F.create_map(*(x for r in found for x in (F.lit(r["declared"]), F.lit(min(1.0, 2 * sample_rows / max(r["texts"], 1))))))
    place = F.pmod("hash", F.lit(1 << 30)).cast("double") / float(1 << 30)
    few = given.where(F.col("declared").isin(languages)).where(place < share[F.col("declared")]).dropDuplicates(["declared", "hash"])
    first = F.row_number().over(Window.partitionBy("declared").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash"))
    chosen = few.withColumn("place", first).where(F.col("place") <= sample_rows).select(F.col("text").cast("binary").alias("text"), "declared")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(BUCKETS, np.int64) for k in languages}
        for batch in batches:
            for text, declared in zip(batch.column(0), batch.column(1)):
                held[declared.as_py()] += np.bincount(trigram_classes(text.as_py()), minlength=BUCKETS)
        for k, n in held.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at), pa.array(n[at])], names=["declared", "class", "n"])

    sums = chosen.mapInArrow(count, "declared string, class long, n long").groupBy("declared", "class").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), 0.5)
    for i, k in enumerate(languages):
        own = sums[sums["declared"] == k]
        table[own["class"].to_numpy(), i] += own["n"].to_numpy()
    table = np.log(table / table.sum(axis=0))
    noise = np.full((BUCKETS, 1), -np.log(BUCKETS))
    return TextModel(languages, np.hstack([table, noise]).astype(np.float32))


def _text_posteriors(rows: DataFrame, model: TextModel, column: str) -> DataFrame:
    """``rows`` with ``_like``, the log-likelihoods of the texts in ``column``."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (languages + 1) numbers
    names = [*rows.columns, "_like"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                like = [m.score(None if x.as_py() is None else x.as_py().encode("utf-8", "replace")).tolist() for x in part.column(column)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(like, pa.list_(pa.float64()))], names=names)

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "`_like` array<double>"])
    return rows.mapInArrow(scan, fields)


def _normalise(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    return F.transform(logs, lambda x: F.exp(x - top))


def identify(
    docs: DataFrame, text: Column | str, declared: Column, host: Column, suffix: Column, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``docs`` with ``language, confidence, text_language, accepted``.

    ``text``, ``declared`` (a language tag), ``host`` and ``suffix`` are
    expressions over ``docs`` (``text`` may be a column's name, which spares a copy) and may be null: a missing text says nothing, a
    missing declaration neither, and rows without host or suffix share the
    level above. ``accepted`` is false where the language is unknown: no
    letters at all, noise, or a posterior below ``threshold``. Where noise is likelier than
    every language with a model, a declared language that has none is taken at its word, with noise's posterior. Columns
    of these names in ``docs`` give way. Without a language that has
    ``LEAST_ROWS`` declared rows all are unknown. Rows keep their number,
    repeats and ties included; an empty table gives an empty one.

    Texts are scored twice, once for the grouped sums and once to decide, and
    never shuffled: what is joined is one row for each host, broadcast
    when a count shows it small.
    """
    out = ["language", "confidence", "text_language", "accepted"]
    names_of = {c: f"_given_{i}" for i, c in enumerate(docs.columns) if c not in out}  # no name of the table can clash with one used here
    given = [docs[c].alias(new) for c, new in names_of.items()]
    back = [F.col(new).alias(c) for c, new in names_of.items()]
    column = names_of[text] if isinstance(text, str) else "_text"
    rows = docs.select(*given, *([] if isinstance(text, str) else [text.alias("_text")]), primary(declared).alias("_declared"), host.alias("_host"), suffix.alias("_suffix"))
    model = train(rows.select(F.col(column).alias("text"), F.col("_declared").alias("declared")), sample_rows)
    if model is None:
        return rows.select(*back, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_language"), F.lit(False).alias("accepted"))
    names, size = [*model.languages, UNKNOWN], len(model.languages) + 1
    start = F.array(*(F.lit(float(np.log((1 - UNKNOWN_PRIOR) / (size - 1)))) for _ in model.languages), F.lit(float(np.log(UNKNOWN_PRIOR))))

    def with_own(frame: DataFrame) -> DataFrame:
        raw = frame.withColumn("_raw", _normalise(F.zip_with("_like", start, lambda a, b: a + b)))
        share = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
        return raw.withColumn("_share", share).withColumn("_own", F.transform("_raw", lambda x: x / F.col("_share"))).drop("_raw", "_share")

    known = F.when(F.col("_declared").isNull(), F.lit("-")).when(F.col("_declared").isin(model.languages), F.col("_declared")).otherwise(F.lit("?"))
    narrow = with_own(_text_posteriors(rows.select(column, "_declared", "_host", "_suffix"), model, column).drop(column)).withColumn("_said", known)
    sums = [F.sum(F.col("_own")[i]).alias(f"s{i}") for i in range(size)]
    counted = materialise(narrow.groupBy("_host", "_suffix", "_said").agg(*sums), "host-counts")
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    # A row for each language and what is declared: (languages + 2) rows at most.
    said = {r["_said"]: np.array([r[f"s{i}"] for i in range(size)]) for r in counted.groupBy("_said").agg(*again).collect()}
    total = sum(said.values(), np.zeros(size))
    whole = (total + 1) / (total + 1).sum()
    trust = {k: np.log((v + 1) / (total + len(said) + 1)) for k, v in said.items()}
    level = lambda *key: counted.groupBy(*key).agg(*again).select(*key, F.array(*(F.col(f"s{i}") for i in range(size))).alias("_sum"))
    by_suffix = level("_suffix")
    base_prior = F.array(*(F.lit(float(x)) for x in whole))
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    by_suffix = by_suffix.withColumn("_n", mass("_sum")).select(
        F.col("_suffix").alias("_s"), F.zip_with("_sum", base_prior, lambda s, p: (s + F.lit(SUFFIX_SMOOTHING) * p) / (F.col("_n") + SUFFIX_SMOOTHING)).alias("_above")
    )
    by_host = level("_host", "_suffix").join(by_suffix, F.col("_suffix").eqNullSafe(F.col("_s"))).drop("_s")
    by_host = materialise(by_host.select(F.col("_host").alias("_h"), F.col("_suffix").alias("_s"), F.col("_sum").alias("_host_sum"), "_above"), "host-priors")
    if by_host.count() * (2 * 8 * size + 128) <= BROADCAST_BYTES:
        by_host = F.broadcast(by_host)

    scored = with_own(_text_posteriors(rows, model, column)).withColumn("_said", known)
    joined = scored.join(by_host, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_suffix").eqNullSafe(F.col("_s")), "left")
    # The row's own share leaves its host's sums; a row without host knows only the level above.
    others = F.when(F.col("_host").isNotNull(), F.zip_with("_host_sum", "_own", lambda s, o: F.greatest(s - o, F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), size))
    joined = joined.withColumn("_others", others).withColumn("_n", mass("_others"))
    prior = F.zip_with("_others", "_above", lambda s, p: F.log((s + F.lit(HOST_SMOOTHING) * p) / (F.col("_n") + HOST_SMOOTHING)))
    none = F.array(*(F.lit(0.0) for _ in names))
    heard = F.lit(None).cast("array<double>")
    for k, v in trust.items():
        if k != "-":
            heard = F.when(F.col("_said") == k, F.array(*(F.lit(float(x)) for x in v))).otherwise(heard)
    joined = joined.withColumn("_heard", F.coalesce(heard, none)).withColumn("_prior", prior)
    joined = joined.withColumn("_log", F.zip_with(F.zip_with("_like", "_prior", lambda a, b: a + b), "_heard", lambda a, b: a + b)).withColumn("_raw", _normalise(F.col("_log")))
    joined = joined.withColumn("_top", F.array_max("_raw")).withColumn("_mass", mass("_raw"))
    named = F.array(*(F.lit(x) for x in names))
    empty = F.forall("_like", lambda x: x == 0)
    language = F.when(empty, F.lit(UNKNOWN)).otherwise(F.element_at(named, F.array_position("_raw", F.col("_top")).cast("int")))
    by_text = F.when(empty, F.lit(UNKNOWN)).otherwise(F.element_at(named, F.array_position("_own", F.array_max("_own")).cast("int")))
    confidence = F.when(empty, F.lit(0.0)).otherwise(F.col("_top") / F.col("_mass"))
    spoken = (language == UNKNOWN) & ~empty & (F.col("_said") == "?")
    language = F.when(spoken, F.col("_declared")).otherwise(language)
    result = joined.select(*back, language.alias("language"), confidence.alias("confidence"), by_text.alias("text_language"))
    return result.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= threshold))


def identify_documents(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``identify`` for a table of documents, whose sources stand for hosts and have no address suffix."""
    return identify(docs, text_col, F.col(declared_col), F.col(host_col).cast("string"), F.lit(None).cast("string"), threshold)


def identify_pages(pages: DataFrame, threshold: float = 0.5, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``identify`` for web pages: the language that the markup declares, and the host and suffix of the address."""
    host = host_of(F.col(url_col))
    return identify(pages, markup_text(F.col(html_col)), markup_language(F.col(html_col)), host, suffix_of(host), threshold)


def accepted_documents(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` whose language is known, with the columns of ``docs``, whatever their names."""
    rows, names = shielded(docs)  # a column that identify() adds may be one of the table's own
    found = identify_documents(rows, text_col=names[text_col], declared_col=names[declared_col], host_col=names[host_col], **options)
    return unshielded(found.where("accepted"), names)
