import numpy as np
import xxhash
from landmarq.llm import simhash
from pyspark.sql import functions as F


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, most=4):
    """(id, fingerprint) pairs to each id's smallest reachable id."""
    groups = {}
    for i, f in rows:
        groups.setdefault(f, []).append(i)
    left, out = set(groups), {}
    while left:
        part, queue = set(), [left.pop()]
        while queue:
            f = queue.pop()
            part.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= most}
            left -= near
            queue += near
        least = min(i for f in part for i in groups[f])
        out |= {i: least for f in part for i in groups[f]}
    return out


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    slow = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    want = slow_components(slow.items())
    got = simhash.hamming_components(docs).collect()
    assert len(got) == len(rows)
    assert all(int(r.fingerprint, 16) == slow[r.doc_id] and r.component_id == want[r.doc_id] for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = simhash.hamming_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = {r.doc_id: r.component_id for r in got if int(r.fingerprint, 16) == 0}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert simhash.hamming_components(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_cells_hold_every_near_pair():
    random = np.random.default_rng(0)
    base = random.integers(0, 2**63, 4000, dtype=np.uint64)
    other = base.copy()
    for i in range(4):
        other ^= np.uint64(1) << random.integers(0, 64, 4000).astype(np.uint64)
    for groups in (5, 6, 7, 8):
        a, b = (simhash._cells_exact(x[:, None], 4, groups) for x in (base, other))
        assert (a == b).any(axis=1).all()


def test_dense_cells_are_split(spark, monkeypatch):
    """One large group of near copies in one cell: blocks lose no link and no pair list is made."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    random = np.random.default_rng(1)
    values = {int(sum(1 << int(b) for b in random.choice(20, random.integers(0, 7), replace=False))) for _ in range(300)}
    rows = [(i, v.to_bytes(8, "big")) for i, v in enumerate(sorted(values))]
    distinct = spark.createDataFrame(rows, "rep long, fp binary")
    links = simhash._links(distinct, 4, lambda fps: simhash._cells_exact(fps, 4, 6))
    parts = {r.node: r.component for r in simhash.connected_components(links).collect()}
    want = slow_components([(i, int.from_bytes(f, "big")) for i, f in rows])
    assert {i: parts.get(i, i) for i, _ in rows} == want


def test_similar_documents_meet_and_strangers_do_not(spark):
    random = np.random.default_rng(2)
    word = lambda: "".join(random.choice(list("abcdefghij"), 5))
    texts, copies = [], []
    for i in range(60):
        words = [word() for _ in range(300)]
        changed = list(words)
        for at in random.choice(300, 3, replace=False):  # 15 of 296 shingles change: resemblance above 0.9
            changed[at] = word()
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        copies.append({2 * i, 2 * i + 1})
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {}
    for r in simhash.near_duplicates(docs).collect():
        found.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, copies))
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {2 * i for i in range(60)}


def test_keep_one_keeps_columns_and_one_row_of_a_group(spark, odd_docs):
    """A repeated row, a copy without an id, a text that only rows without ids hold, and a repeated id with another text."""
    new = spark.createDataFrame([(None, "own text without any id"), (None, "own text without any id"), (None, "one"), (5, "a text of another kind under the same id")], "doc_id long, text string")
    more = odd_docs.limit(0).unionByName(new, allowMissingColumns=True)
    kept = simhash.keep_one(odd_docs.union(more))
    assert kept.columns == odd_docs.columns
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    assert [r[0] for r in rows] == [-1, 0, 1, 5, 5, 6, 7, 8, 9, 10] and rows[0][1] == "own text without any id"
    classes = simhash.near_duplicates(odd_docs.union(more)).collect()
    assert len(classes) == odd_docs.count() + 4
    assert [r.component_id for r in classes if r.doc_id is None].count(None) == 2


def test_the_same_id_links_no_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (0, "a b c d e f"), (2, "u v w x y z"), (None, "q r s t u v"), (3, "q r s t u v")]
    got = simhash.hamming_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.component_id, r.doc_id or -1) for r in got) == [(0, -1), (0, 1), (1, 1), (1, 2), (3, -1), (3, 3)]


def test_manhattan_is_a_lower_bound():
    random = np.random.default_rng(3)
    a, b = random.integers(0, 2**63, (2, 2000), dtype=np.uint64)
    counts = [[(int(x) >> 2 * i & 1) + (int(x) >> 2 * i + 1 & 1) for i in range(32)] for x in np.r_[a, b]]
    slow = [sum(abs(p - q) for p, q in zip(x, y)) for x, y in zip(counts[:2000], counts[2000:])]
    got = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    assert got.tolist() == slow and (got <= np.bitwise_count(a ^ b)).all()
