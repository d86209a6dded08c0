"""Near-duplicate documents by SimHash.

Fingerprints that differ in few bits are found by a segment-popcount embedding:
the 64 bits fall into 32 segments of two, and a fingerprint maps to the vector
of its segments' bit counts. The Manhattan distance of two such vectors never
exceeds the number of differing bits, so links lie within that distance. The
segments are dealt into groups; two vectors at distance r or less agree wholly
in all but r of them, so the grid whose cells are the count vectors of (groups
- r) groups brings every linked pair together in some cell. Pairs of a cell
whose count vectors lie further apart are left out by the Manhattan distance;
what it leaves is checked on the bits themselves.

Links at a set similarity take the same way first: fingerprints of the sets, the
embedding, the grid and the distances name near pairs, which are counted exactly.
Sets just above the similarity differ in more bits than a count vector can tell from strangers, so pairs
that the fingerprints leave apart are found by the sets themselves, exactly (see ``near_duplicates``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import has_unique_ids, materialise, numbered, shielded, unshielded
from .components import connected_components
from .resemblance import resemblance_components
from .shingles import shingle_hashes

#: Bit j of a byte value, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
#: How many shingle hashes are counted at a time.
_CHUNK = 8192
#: A cell with more members than this is split into blocks that are compared two by two.
BLOCK = 16384
#: Differing bits up to which near duplicates are named by their fingerprints.
NEAR_BITS = 4
#: Runs up to this length are compared in one vector pass.
_SHORT = 48


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64 bits of each hash; the hash itself for k = 0."""
    if not k:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """The ``width`` 64-bit words whose bits are 1 where more than half of the hashes have 1; zero for no hash."""
    counts = np.zeros((width * 8, 8))
    base = np.arange(width * 8) * 256
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        spread = np.stack([_spread(part, k) for k in range(width)], axis=1)
        each = spread.view(np.uint8).reshape(len(part), width * 8) + base
        counts += np.bincount(each.ravel(), minlength=width * 2048).reshape(width * 8, 256) @ _BITS
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").ravel().view(np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint's words as big-endian bytes, for every row.

    Null, empty and blank texts have fingerprint zero. Other columns are not
    read. Texts are taken whole, their shingles counted a chunk at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(x.as_py(), shingle_words), width).astype(">u8").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"id {kind}, fp binary").withColumnRenamed("id", id_col)


def embed(x: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments of each fingerprint, in unary: 0 is 00, 1 is 01 and 2 is 11."""
    low = np.uint64(0x5555555555555555)
    one, two = x & low, (x >> np.uint64(1)) & low
    return (one | two) | ((one & two) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embedded count vectors: unary counts differ in as many bits as they lie apart."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def _cells_exact(fps: np.ndarray, max_bits: int, groups: int) -> np.ndarray:
    """Cells of the count grid, one column for each choice of (groups - max_bits) groups of segments."""
    counts = embed(fps[:, 0])
    masks = []
    for part in np.array_split(np.arange(32), groups):
        masks.append(np.uint64(sum(3 << int(2 * s) for s in part)))
    out = []
    for i, chosen in enumerate(itertools.combinations(masks, groups - max_bits)):
        mask = np.bitwise_or.reduce(np.array(chosen, np.uint64))
        out.append(_spread(counts & mask, i + 1))
    return np.stack(out, axis=1).view(np.int64)


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)


def _linked(counts_a: np.ndarray, counts_b: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are linked: the Manhattan distance of their counts rules out most, the bits decide the rest."""
    near = manhattan(counts_a, counts_b) <= max_bits
    left = np.flatnonzero(near)
    near[left] = np.bitwise_count(a[left] ^ (b[left] if b.shape else b)) <= max_bits
    return near


def _link_long(reps: np.ndarray, counts: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the members of each connected part of one cell, without listing all pairs."""
    edges, left = [], np.arange(len(reps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _linked(counts[left], counts[at], fps[left], fps[at], max_bits)
            for other in left[near]:
                edges.append((int(reps[at]), int(reps[other])))
                queue.append(other)
            left = left[~near]
    return edges


def _link_sorted(max_bits: int):
    """A function over rows sorted by cell that gives the links inside each cell, ``u, v``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(cells, reps, fps):
            bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
            lengths = np.diff(bounds)
            found = []
            counts = embed(fps)

            longest = int(lengths.max(initial=0))
            short = np.repeat(lengths <= _SHORT, lengths)
            for d in range(1, min(longest, _SHORT + 1)):
                at = np.flatnonzero((cells[d:] == cells[:-d]) & short[:-d])
                for part in np.array_split(at, max(1, len(at) // 200_000)):
                    near = part[_linked(counts[part], counts[part + d], fps[part], fps[part + d], max_bits)]
                    found.append((reps[near], reps[near + d]))
            for i in np.flatnonzero(lengths > _SHORT):
                members = slice(bounds[i], bounds[i + 1])
                if pairs := _link_long(reps[members], counts[members], fps[members], max_bits):
                    found.append(tuple(np.array(pairs, np.int64).T))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fps = _unpack(batch.column(2), 1)[:, 0]
            held.append((cells, reps, fps))
            if cells[0] == cells[-1] and held[0][0][0] == cells[0]:
                continue  # one cell goes on
            cells, reps, fps = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(cells, cells[-1]))
            yield from links(cells[:last], reps[:last], fps[:last])
            held = [(cells[last:], reps[last:], fps[last:])]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))

    return scan


def _links(distinct: DataFrame, max_bits: int, cells) -> DataFrame:
    """Links ``u, v`` between representatives: for each connected part enough to join it.

    ``distinct`` has ``rep`` (long) and ``fp``. A cell of more than ``BLOCK``
    members is split into blocks, each pair of which is a cell of its own, so
    that no task holds more than two blocks of it and no pair is lost.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = _unpack(part.column(1), 1)
                grid = cells(fps)
                rows = np.repeat(np.arange(len(fps)), grid.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(grid.ravel()), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], names=["cell", "rep", "fp"])

    dealt = distinct.select("rep", "fp").mapInArrow(deal, "cell long, rep long, fp binary")
    large = materialise(dealt.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-cells")
    if not large.isEmpty():
        # As many as all memberships over BLOCK at most; Spark broadcasts them only if its own threshold allows.
        dealt = dealt.join(large, "cell", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("other", other).select(
            F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"), "rep", "fp"
        )
    together = dealt.repartition("cell").sortWithinPartitions("cell", "rep")
    return together.mapInArrow(_link_sorted(max_bits), "u long, v long")


def groups_for(rows: int, max_bits: int, wanted: int = 64) -> int:
    """The least number of segment groups whose cells hold about ``wanted`` unrelated fingerprints at most.

    Two random segments of two bits have equal counts in 3/8 of all cases. Any number of groups brings all linked
    pairs together; it sets the work alone.
    """
    for groups in range(max_bits + 1, max_bits + 5):
        if rows * 0.375 ** (32 * (groups - max_bits) / groups) <= wanted:
            return groups
    return max_bits + 4


def _classes(fps: DataFrame, id_col: str, linker) -> DataFrame:
    """``id_col, fp, component_id`` from fingerprints: equal ones first, then links between their least ids."""
    fps = materialise(fps, "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("rep")).where("rep is not null"), "distinct")
    found = linker(distinct, distinct.count())
    parts = connected_components(found)
    named = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(id_col, "fp", "component_id")


def _by_number(docs: DataFrame, id_col: str, text_col: str, classify) -> DataFrame:
    """What ``classify`` makes of documents of which each has an id of its own.

    Where ids repeat or are null the rows get numbers in the order of their ids (nulls last), and
    the least number's id names the component: null where no row of it has an id.
    """
    if has_unique_ids(docs, id_col):
        return classify(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumnRenamed("id", id_col)
    rows = numbered(docs.select(F.col(id_col).alias("_given"), F.col(text_col).alias("text")), "_given", "id")
    named = rows.select(F.col("id").alias("_n"), "_given").hint("merge")
    found = classify(rows.select("id", "text")).withColumnRenamed("component_id", "_least")
    least = rows.select(F.col("id").alias("_l"), F.col("_given").alias("component_id")).hint("merge")
    out = found.join(named, F.col("id") == F.col("_n")).join(least, F.col("_least") == F.col("_l"))
    return out.drop("id", "_n", "_least", "_l").withColumnRenamed("_given", id_col)


def hamming_components(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    Two rows are linked when their 64-bit fingerprints differ in ``max_bits``
    bits or fewer; ``component_id`` is the smallest id reachable over links.
    Ids are integers. Null and empty texts have fingerprint zero and are linked
    like any other. Each row is a document of its own: repeated rows come back
    as often as they came, a repeated id doesn't link different texts, and rows
    with a null id link like others (a component without any id has a null
    one). Other columns are ignored. An empty table gives an empty one.
    """

    def classify(rows: DataFrame) -> DataFrame:
        out = _classes(fingerprints(rows, shingle_words, 1, "id", "text"), "id", _exact_linker(max_bits))
        return out.select("id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")

    return _by_number(docs, id_col, text_col, classify).select(id_col, "fingerprint", "component_id")


def _set_fingerprint(members: np.ndarray) -> bytes:
    return majority_bits(members).astype(">u8").tobytes()


def _exact_linker(max_bits: int):
    """A function over distinct fingerprints ``rep, fp`` and their number that gives links ``u, v``, by the grid of their counts."""

    def linker(distinct: DataFrame, rows: int) -> DataFrame:
        groups = groups_for(rows, max_bits)
        return _links(distinct, max_bits, lambda fps: _cells_exact(fps, max_bits, groups))

    return linker


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id`` where rows whose shingle sets resemble each other by ``similarity`` are linked.

    Pairs of sets whose fingerprints (of distinct shingles) differ in ``NEAR_BITS`` bits or fewer come from the embedding
    as in ``hamming_components``; every link is counted exactly on the sets, and every other pair that
    reaches ``similarity`` is joined too (see ``resemblance``).
    Nulls, ties, repeats, empty tables: as ``hamming_components``; texts without words are alike.
    """
    return _by_number(docs, id_col, text_col, lambda rows: resemblance_components(rows, shingle_words, similarity, _exact_linker(NEAR_BITS), _set_fingerprint)).select(id_col, "component_id")


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates (see ``near_duplicates``): that with the smallest id.

    Of rows that share that id one stays; rows with a null id come last, so one of a group without any id stays.
    All columns of ``docs`` come back under their names. An empty table gives an empty one.
    """
    rows, names = shielded(docs)
    key, text = names[id_col], names[text_col]
    if not has_unique_ids(rows, key):
        rows = numbered(rows, key, "_row")
        key = "_row"
    classes = near_duplicates(rows, shingle_words, similarity, key, text)
    kept = materialise(classes.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_kept")), "kept")
    # The ids kept grow with the table, so they are never broadcast, however few they are now.
    return unshielded(rows.join(kept.hint("merge"), F.col(key) == F.col("_kept"), "left_semi"), names)
