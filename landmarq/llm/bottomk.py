"""Bottom-k sketches of documents' shingle hashes, in built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's
shingles. Sketches of parts merge into the sketch of the whole. From two
sketches come estimates of resemblance and containment, and from one the number
of distinct shingles; texts with fewer than ``k`` distinct shingles are compared exactly.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, has_unique_ids, materialise, with_prefix

#: Hashes in a sketch: a standard error of 0.044 at a resemblance of one half.
K = 128
SHINGLE_WORDS = 5
_BLANKS = " \t\n\x0b\f\r"
#: Sampled ids for each cut of the order into stretches, stretches for each task, rows that make a stretch worth while.
_PER_CUT, _EACH_TASK, _LEAST_STRETCH = 32, 8, 64


def _word_hashes(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, SPACE), lambda w: F.xxhash64(w)))


def _sketch(hashes: Column, k: int, words: int) -> Column:
    """``hashes``: a column (not an expression) of word hashes."""
    n = F.size(hashes)
    rolled = F.transform(F.slice(hashes, F.lit(1), n - (words - 1)), lambda x, i: F.xxhash64(x, *(hashes[i + j] for j in range(1, words))))
    every = F.when(n >= words, rolled).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def with_sketch(docs: DataFrame, text_col: str = "text", out_col: str = "sketch", k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the sketch of the whole text; that of null, empty or blank text is empty.

    With fewer than ``words`` words the whole sequence is the one shingle. A
    column named ``out_col`` gives way. Equal texts have equal sketches.
    """
    hashed = docs.withColumn("_word_hashes", _word_hashes(F.coalesce(F.col(text_col), F.lit(""))))
    return hashed.withColumn(out_col, _sketch(F.col("_word_hashes"), k, words)).drop("_word_hashes")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of all shingles of both; 1 for two empty sketches."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union).cast("double"))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of ``a``'s shingles that ``b`` has; 1 where ``a`` is empty."""
    alike, mine, other = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), alike * (mine + other) / ((1 + alike) * mine)))


def serialise(sketch: Column) -> Column:
    """Sixteen hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_groups(sketched: DataFrame, keys: Sequence[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``keys`` and the merged sketch of each group of rows.

    Each task keeps its own ``k`` smallest hashes of a group ahead of the shuffle,
    so a group that holds most rows sends no more than ``k`` from each task.
    Null keys form groups like any other; a group of empty sketches has an empty one.
    """
    hashes = sketched.select(*keys, F.explode_outer(sketch_col).alias("_hash")).distinct()
    ranked = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last()))).where(F.col("_rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch_col))


def _cuts(rows: DataFrame, key: str, stretches: int) -> list:
    """Keys, descending, that cut ``rows`` into about even ``stretches``: each is some row's, taken from a bounded sample by hash."""
    sample = rows.select(key).orderBy(F.xxhash64(key), key).limit(stretches * _PER_CUT)
    placed = sample.withColumn("_place", F.row_number().over(Window.orderBy(F.col(key).desc())) - 1)
    return [r[0] for r in placed.where((F.col("_place") % _PER_CUT == 0) & (F.col("_place") > 0)).orderBy("_place").select(key).collect()]


def _stretch(key: Column, kind: str, cuts: Sequence) -> tuple[Column, Column]:
    """How many cuts aren't below ``key``, and whether it is one itself: first the block of cuts is found, then the place inside it."""
    if not cuts:
        return F.lit(0), F.lit(False)
    size = math.isqrt(len(cuts) - 1) + 1
    blocks = [list(map(str, cuts[i : i + size])) for i in range(0, len(cuts), size)]
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<string>").cast(f"array<{kind}>")
    whole = F.from_json(F.lit(json.dumps(blocks)), "array<array<string>>").cast(f"array<array<{kind}>>")
    block = F.size(F.filter(heads, lambda c: c >= key))
    own = F.element_at(whole, F.greatest(block, F.lit(1)))
    inside = F.size(F.filter(own, lambda c: c >= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * size + inside), (block > 0) & (F.element_at(own, F.greatest(inside, F.lit(1))) == key)


def with_next(docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``next_<column>`` of the next row in descending ``id_col``; after the last comes the first.

    The order is cut into stretches at ids of a sample, so they hold about as many rows each,
    however the ids are spread and of whatever type they are. Each cut is a row's id: that row, its stretch's
    first, is dealt to the stretch ahead of it as well, so one exchange of the rows
    serves and a task holds a few stretches. Rows with one id go in order of text, null ids come last; where there are such,
    rows are first numbered by range partitions, and the numbers stand for the ids.
    """
    rows, key = docs, id_col
    if not has_unique_ids(docs, id_col):
        ranked = with_prefix(docs, [F.col(id_col).desc_nulls_last(), F.col(text_col)], name="ranked")
        rows, key = materialise(ranked.withColumn("_key", -F.col("_index")).drop("_index", "_before"), "ranked"), "_key"
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top")).first()
    cuts = _cuts(rows, key, max(1, min(_EACH_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), found["n"] // _LEAST_STRETCH)))
    stretch, leads = _stretch(F.col(key), dict(rows.dtypes)[key], cuts)
    rows = rows.withColumn("_stretch", stretch).withColumn("_leads", leads)
    place = lambda at, lap, extra: F.struct(at.cast("int").alias("at"), F.lit(lap).alias("lap"), F.lit(extra).alias("extra"))
    places = F.array_compact(
        F.array(
            place(F.col("_stretch"), 0, False),
            F.when(F.col("_leads"), place(F.col("_stretch") - 1, 0, True)),
            F.when(F.col(key) == F.lit(found["top"]).cast(dict(rows.dtypes)[key]), place(F.lit(len(cuts)), 1, True)),
        )
    )
    rows = rows.withColumn("_place", F.explode(places)).select(*docs.columns, F.col(key).alias("_key"), "_place.*")
    order = Window.partitionBy("at").orderBy("lap", F.col("_key").desc())
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("extra")).drop("_key", "at", "lap", "extra")


def edit_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text are.

    The edited text has the last floor(n/3) of its n code points replaced by the
    first as many (or all) of the next row's text (see ``with_next``). Gives
    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, distinct_shingles, containment_edited``. A null text is an empty
    one; two empty texts are alike. One row alone is its own next. An empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sketched = with_sketch(base, "_text", "_sketch", k, words)
    rows = with_next(sketched, ["_text", "_sketch"], "_id", "_text")
    n = F.char_length("_text")
    cut = F.floor(n / F.lit(3)).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("next__text"), F.lit(1), cut))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), "_sketch", "next__sketch", edited.alias("_edited"))
    rows = with_sketch(rows, "_edited", "_edited_sketch", k, words)
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), serialise(F.col("_sketch")).alias("fingerprint"), serialise(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"), resemblance(F.col("_sketch"), F.col("next__sketch"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("distinct_shingles"), containment(F.col("_edited_sketch"), F.col("_sketch"), k).alias("containment_edited"),
    )
