"""Links between texts whose sets of shingles resemble each other, found and verified exactly.

Pairs that near fingerprints name are verified and joined first (see ``simhash``); what follows finds every pair
that they leave apart. Two sets with resemblance ``similarity`` or more share one of the first ``n -
ceil(similarity * n) + 1`` members of each in any common order (the prefix
filter), so the cells are those shingles and no pair is lost, however short the
texts are or often a line repeats. The order puts shingles that are frequent
in a sample of the texts last, which keeps cells small; it has no bearing on the
result, which covers all texts. Pairs of small cells are listed and counted on the sets. In a crowded
cell a spanning forest of the pairs that a bound can't rule out is counted
instead, so that a large group of copies is never listed pair by pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import discard, materialise
from .components import connected_components
from .shingles import shingle_hashes

#: A cell with more members than this is crowded.
DENSE = 8
#: A crowded cell with more members than this is split into blocks that are compared two by two.
BLOCK = 16384
#: Bits of a set's parities for each member, rounded up to a power of two: so many tell sets just below the limit from copies at any length.
BITS_EACH = 4
#: Rounds over crowded cells: in all but the last a spanning forest is verified, in the last every pair that is left.
ROUNDS = 3
#: The order of shingles is learned from so many texts at least, and from one in so many: so a shingle of over about 30,000 texts is
#: known as frequent however many texts there are, and cells stay below that. It knows so many shingles for each text of the sample, up to a bound.
SAMPLE, ONE_IN, KNOWN_EACH, MOST_KNOWN = 10_000, 10_000, 5, 1_000_000


def _set_of(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def prefix(members: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members that any set with resemblance ``similarity`` shares one of; ``frequent`` (sorted) come last."""
    if not len(members):
        return members
    rank = np.zeros(len(members), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rank = np.where(frequent[at] == members, counts[at], 0)
    return members[np.lexsort((members, rank))[: len(members) - math.ceil(similarity * len(members) - 1e-9) + 1]]


def parities(members: np.ndarray) -> np.ndarray:
    """Whether an odd number of members falls on each bit: two sets differ in as many members as bits at least.

    Sets of sizes that one may resemble the other have as many bits or twice as many; halves
    laid over each other (exclusive or) give the parities on half the bits.
    """
    bits = max(64, 1 << (BITS_EACH * len(members) - 1).bit_length()) if len(members) else 64
    odd = np.bincount((members >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of parities differ, where one side may have twice as many."""
    if a.shape[-1] > b.shape[-1]:
        a = _folded(a)
    elif b.shape[-1] > a.shape[-1]:
        b = _folded(b)
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Members:
    """Sizes and parities of the members of a cell, by width."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.n, self.width = n, np.array([len(b) // 8 for b in bits], np.int64)
        self.slot, self.rows = np.empty(len(n), np.int64), {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            self.slot[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join(bits[at]), np.uint64).reshape(-1, w)

    def near(self, at: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``others`` that sizes and parities don't rule out as partners of ``at``."""
        own = self.rows[self.width[at]][self.slot[at]]
        others = others[_sizes_fit(self.n[others], self.n[at], similarity)]
        keep = np.zeros(len(others), bool)
        for w in np.unique(self.width[others]):
            some = np.flatnonzero(self.width[others] == w)
            rows = self.rows[w][self.slot[others[some]]]
            keep[some] = _apart(rows, own) <= _most_apart(self.n[others[some]], self.n[at], similarity)
        return others[keep]


def _sizes_fit(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def _most_apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many members only one of two sets may hold at that resemblance."""
    return (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def _frequent(texts: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, sorted, and of how many."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [_set_of(x.as_py(), shingle_words) for x in batch.column(1).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    count = texts.count()
    sample = max(SAMPLE, count // ONE_IN)
    every = max(1, math.ceil(count / sample))
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(scan, "shingle long")
    found = some.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(min(KNOWN_EACH * sample, MOST_KNOWN)).toArrow()
    shingles, counts = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(shingles.view(np.uint64), kind="stable")
    return shingles.view(np.uint64)[order], counts[order].astype(np.int64)


def _by_cell(each: Callable) -> Callable:
    """A function over rows sorted by their first column, ``cell``, that calls ``each`` with the columns of whole cells; binaries come as objects."""

    def column(values: pa.Array) -> np.ndarray:
        if not pa.types.is_binary(values.type):
            return values.to_numpy(zero_copy_only=False)
        out = np.empty(len(values), object)
        out[:] = values.to_pylist()
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([column(c) for c in batch.columns])
            if held[-1][0][-1] == held[0][0][0]:
                continue  # one cell goes on
            whole = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from each(*(x[:last] for x in whole))
            held = [[x[last:] for x in whole]]
        if held:
            yield from each(*(np.concatenate(x) for x in zip(*held)))

    return scan


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    return bounds, np.diff(bounds)


def _cells(reps: DataFrame, similarity: float) -> DataFrame:
    """``cell, u, v``: the pairs of small cells (``cell`` null) and the members of crowded ones (``v`` null).

    ``reps`` has ``rep, n, members``, the prefix in the common order. Two sets whose first
    common member stands at places i and j share no more than that one and what follows it on the
    shorter rest, so a pair that meets too late in either is left out. At their first common member no wanted pair is.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                members = part.column(2).to_pylist()
                sizes = np.array([len(x) // 8 for x in members], np.int64)
                places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [np.frombuffer(b"".join(members), np.int64), *(np.repeat(part.column(i).to_numpy(), sizes) for i in (0, 1)), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "rep", "n", "place"])

    def each(cells: np.ndarray, reps: np.ndarray, n: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, lengths = _runs(cells)
        small = np.repeat(lengths <= DENSE, lengths)
        rest = n - places  # this member and those after it
        for d in range(1, DENSE):
            at = np.flatnonzero((cells[d:] == cells[:-d]) & small[:-d])
            a, b = n[at], n[at + d]
            likely = np.minimum(rest[at], rest[at + d]) >= similarity / (1 + similarity) * (a + b) - 1e-6
            at = at[likely & _sizes_fit(a, b, similarity)]
            u, v = reps[at], reps[at + d]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["cell", "u", "v"])
        if not small.all():
            yield pa.RecordBatch.from_arrays([pa.array(cells[~small]), pa.array(reps[~small]), pa.nulls(int((~small).sum()), pa.int64())], names=["cell", "u", "v"])

    dealt = reps.select("rep", "n", "members").mapInArrow(deal, "cell long, rep long, n long, place long")
    return dealt.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(_by_cell(each), "cell long, u long, v long")


def _sets(texts: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``id, members`` of the texts whose id is in ``wanted``: ids grow with the table, so they are joined by sort-merge, not broadcast."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [_set_of(x.as_py(), shingle_words).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "members"])

    chosen = texts.join(wanted.select(F.col("id").alias("_i")).distinct().hint("merge"), F.col("id") == F.col("_i"), "left_semi")
    return materialise(chosen.mapInArrow(hashed, "id long, members binary"), "shingle-sets")


def resembling(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``u, v``, ids) with sets that resemble each other by ``similarity`` or more, counted exactly."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("members").alias("a")).hint("merge"), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("members").alias("b")).hint("merge"), "v")
    return both.select("u", "v", "a", "b").mapInArrow(compared, "u long, v long")


def _possible(pairs: DataFrame, described: DataFrame, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (``u, v``) that sizes and parities (``rep, n, parities``) leave open: only their texts are fetched."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            fit = np.flatnonzero(_sizes_fit(n, m, similarity))
            a, b = (batch.column(i).take(pa.array(fit)).to_pylist() for i in (4, 5))
            widths = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
            keep = np.zeros(batch.num_rows, bool)
            for v, w in np.unique(widths, axis=0):
                some = np.flatnonzero((widths == (v, w)).all(axis=1))
                x, y = (np.frombuffer(b"".join(side[i] for i in some), np.uint64).reshape(len(some), -1) for side in (a, b))
                keep[fit[some]] = _apart(x, y) <= _most_apart(n[fit[some]], m[fit[some]], similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    ends = [described.select(F.col("rep").alias(e), F.col("n").alias(f"n_{e}"), F.col("parities").alias(f"p_{e}")).hint("merge") for e in ("u", "v")]
    bounded = pairs.distinct().join(ends[0], "u").join(ends[1], "v").select("u", "v", "n_u", "n_v", "p_u", "p_v")
    return bounded.mapInArrow(possible, "u long, v long")


def _unsettled(reps: np.ndarray, labels: np.ndarray, members: Members, similarity: float, turn: int) -> list[tuple[int, int]]:
    """Pairs of one cell in different components that the bounds leave open: in the last turn all, before a spanning forest of them.

    The forest grows from the least ids, in the next turn from the largest, so cells that hold the same texts name the same pairs.
    """
    found: list[tuple[int, int]] = []
    part = np.unique(labels, return_inverse=True)[1]
    left = np.argsort(-reps if turn % 2 else reps, kind="stable")
    if turn == ROUNDS - 1:
        for i, at in enumerate(left):
            rest = left[i + 1 :]
            found += [(int(reps[at]), int(reps[j])) for j in members.near(at, rest[part[rest] != part[at]], similarity)]
        return found
    while len(left):
        queue = list(left[part[left] == part[left[0]]])
        left = left[part[left] != part[left[0]]]
        while queue and len(left):
            at = queue.pop(0)
            hit = members.near(at, left, similarity)
            if len(hit):
                parts, first = np.unique(part[hit], return_index=True)
                found += [(int(reps[at]), int(reps[j])) for j in hit[first]]
                joined = np.isin(part[left], parts)
                queue += list(left[joined])
                left = left[~joined]
    return found


def _open_pairs(crowded: DataFrame, described: DataFrame, labels: DataFrame | None, similarity: float, turn: int) -> DataFrame:
    """Distinct ``u, v`` (u below v) of crowded cells that ``_unsettled`` gives; without ``labels`` each text is a component.

    A cell of more than ``BLOCK`` members is split into blocks, each pair of
    which is a cell of its own, so that no task holds more than two blocks of it.
    """

    def each(cells, reps, n, parts, bits) -> Iterator[pa.RecordBatch]:
        bounds, _ = _runs(cells)
        found = set()
        for a, b in zip(bounds[:-1], bounds[1:]):
            found.update((min(p), max(p)) for p in _unsettled(reps[a:b], parts[a:b], Members(n[a:b], bits[a:b]), similarity, turn))
        if found:
            u, v = np.array(sorted(found), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    dealt = crowded.join(described.hint("merge"), "rep")
    part = F.col("rep")
    if labels is not None:
        dealt, part = dealt.join(labels.hint("merge"), F.col("rep") == F.col("node"), "left"), F.coalesce("component", "rep")
    dealt = dealt.select("cell", "rep", "n", part.alias("part"), "parities")
    large = materialise(crowded.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-cells")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cell = F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
        dealt = dealt.join(large, "cell", "left").withColumn("own", own).withColumn("other", other).select(cell.alias("cell"), "rep", "n", "part", "parities")
    together = dealt.repartition("cell").sortWithinPartitions("cell", "rep")
    return together.mapInArrow(_by_cell(each), "u long, v long").where("u <> v").distinct()


def _links(texts: DataFrame, cells: DataFrame, described: DataFrame, shingle_words: int, similarity: float, near: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Verified links ``u, v``, enough to join each connected part of the texts in ``cells``: those of ``near`` (links, and their ends' sets) and what they leave apart.

    In a crowded cell a forest over all open pairs is verified; where a link of it
    fails, the parts that are left apart are tried again, at last pair by pair, but no pair twice. Every text with an
    open pair is in the first forest or has its set already, so sets are made of the texts once.
    """
    crowded = cells.where("cell is not null").select("cell", F.col("u").alias("rep"))
    labels = None if near is None else connected_components(near[0])
    plain = cells.where("cell is null and u <> v").select("u", "v")
    if labels is not None:
        ends = [labels.select(F.col("node").alias(e), F.col("component").alias(f"c_{e}")).hint("merge") for e in ("u", "v")]
        plain = plain.join(ends[0], "u", "left").join(ends[1], "v", "left").where("c_u is null or c_v is null or c_u <> c_v").select("u", "v")
    plain = materialise(_possible(plain, described, similarity), "possible")
    forest = materialise(_open_pairs(crowded, described, labels, similarity, 0), "open-pairs")
    tried = plain.union(forest).distinct()
    wanted = tried.select(F.explode(F.array("u", "v")).alias("id"))
    if near is not None:  # any member of a part may be tried in a later round, and all of them are there
        wanted = wanted.join(near[1].select("id").hint("merge"), "id", "left_anti")
    made = _sets(texts, wanted, shingle_words)
    sets = made if near is None else made.union(near[1])
    links = materialise(resembling(tried, sets, similarity), "links")
    found = links
    links = links if near is None else links.union(near[0])
    failed = forest.join(found.hint("merge"), ["u", "v"], "left_anti")
    for turn in range(1, ROUNDS):
        if failed.isEmpty():  # the forest held, so what it joins is one part
            break
        forest = materialise(_open_pairs(crowded, described, connected_components(links), similarity, turn).join(tried.hint("merge"), ["u", "v"], "left_anti"), "open-pairs")
        good = materialise(resembling(forest, sets, similarity), "links")
        # A pair that had failed before may stand for the next forest's, so only the last round settles what is left.
        tried, links = tried.union(forest), links.union(good)
    for one in (made, *(near[1:] if near else ())):
        discard(one)
    return links


def _fingerprint_links(texts: DataFrame, reps: DataFrame, described: DataFrame, linker: Callable, shingle_words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified links ``u, v`` among the pairs that ``linker`` finds by the fingerprints of ``reps`` (``rep, fp``), and the sets (``id, members``) of all these pairs.

    Sets with equal fingerprints are candidates of the least id among them.
    """
    distinct = materialise(reps.groupBy("fp").agg(F.min("rep").alias("rep")), "distinct")
    stars = reps.join(distinct.select("fp", F.col("rep").alias("u")).hint("merge"), "fp").select("u", F.col("rep").alias("v")).where("u <> v")
    pairs = materialise(_possible(linker(distinct, distinct.count()).union(stars), described, similarity), "near-fingerprints")
    sets = _sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("id")), shingle_words)
    return materialise(resembling(pairs, sets, similarity), "links"), sets


def resemblance_components(docs: DataFrame, shingle_words: int, similarity: float, linker: Callable | None = None, fingerprint: Callable | None = None) -> DataFrame:
    """``id, component_id`` of documents ``id, text`` with unique integer ids: equal sets first, then links between their least ids.

    ``linker`` finds near pairs ``u, v`` of a table ``rep, fp`` by the ``fingerprint`` of the sets; what it finds is verified and
    joined first, and only pairs that this leaves apart are looked for by common shingles.
    """
    ship(docs.sparkSession)
    kind = docs.schema["id"].dataType
    texts = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(texts, shingle_words))  # 16 bytes for each shingle known: 16 MB at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [_set_of(x.as_py(), shingle_words) for x in part.column(1)]
                columns = [
                    part.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([prefix(s, similarity, frequent, counts).tobytes() for s in sets], pa.binary()), pa.array([parities(s).tobytes() for s in sets], pa.binary()),
                    pa.array([None if fingerprint is None else fingerprint(s) for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "set_key", "n", "members", "parities", "fp"])

    rows = materialise(texts.mapInArrow(scan, "id long, set_key binary, n long, members binary, parities binary, fp binary"), "set-keys")
    keys = materialise(rows.select("id", "set_key"), "keys")
    least = materialise(keys.groupBy("set_key").agg(F.min("id").alias("rep")), "least")
    # As many sets as texts, nearly, so nothing is broadcast.
    reps = rows.join(least.select(F.col("rep").alias("_r")).hint("merge"), F.col("id") == F.col("_r"), "left_semi").withColumnRenamed("id", "rep")
    described = materialise(reps.select("rep", "n", "parities"), "described")
    near = None if linker is None else _fingerprint_links(texts, materialise(reps.select("rep", "fp"), "set-fingerprints"), described, linker, shingle_words, similarity)
    cells = materialise(_cells(reps, similarity), "cells")
    discard(rows)
    parts = connected_components(_links(texts, cells, described, shingle_words, similarity, near))
    discard(described)
    discard(cells)
    named = least.join(parts.hint("merge"), F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    return keys.join(named.hint("merge"), "set_key").select(F.col("id").cast(kind).alias("id"), F.col("component_id").cast(kind).alias("component_id"))
