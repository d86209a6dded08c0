"""Links at a set similarity, against every pair counted."""

import numpy as np
import pytest
from landmarq.llm import resemblance, simhash


def grams(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def slow_components(texts, similarity=0.8):
    """Ids' smallest reachable id, from every pair's exact resemblance."""
    sets = {i: grams(t) for i, t in texts}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                u, v = sorted((root(i), root(j)))
                least[v] = u
    return {i: root(i) for i in ids}


def components(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}


def words(random, n):
    return ["".join(x) for x in random.choice(list("abcdefghijklmnop"), (n, 7))]


def test_boilerplate_family_stays_apart(spark):
    """Any two of these resemble each other by 0.76: none is a copy, though every one is near to all."""
    random = np.random.default_rng(3)
    core = words(random, 263)
    texts = [(i, " ".join(core + words(random, 41))) for i in range(120)]
    assert components(spark, texts) == {i: i for i in range(120)}


def test_repeated_line_makes_no_copies(spark):
    random = np.random.default_rng(4)
    line = words(random, 9)
    texts = [(i, " ".join(line * 40 + words(random, 60))) for i in range(30)]
    assert components(spark, texts) == {i: i for i in range(30)}


@pytest.mark.parametrize(("body", "times"), [(300, 10), (200, 5), (600, 10)])
def test_repeats_hide_no_copy(spark, body, times):
    random = np.random.default_rng(5)
    texts = []
    for i in range(20):
        start, line = words(random, body), words(random, 12)
        texts += [(2 * i, " ".join(start + line)), (2 * i + 1, " ".join(start + line * times))]
    got = components(spark, texts)
    assert slow_components(texts) == got == {i: i - i % 2 for i in range(40)}


def test_short_texts_at_the_threshold_all_meet(spark):
    random = np.random.default_rng(6)
    texts = []
    for i in range(300):
        body = words(random, 9 if i % 2 else 19)
        texts += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body[: 8 if i % 2 else 16]))]
    got = components(spark, texts)
    assert got == {i: i - i % 2 for i in range(600)}


@pytest.mark.parametrize("block", [16384, 16])
def test_chains_in_crowded_cells(spark, monkeypatch, block):
    """Families whose members drift away from each other: some pairs link, most don't."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    random = np.random.default_rng(7)
    texts, core = [], words(random, 100)
    for i in range(150):
        changed = list(core)
        for at in random.choice(100, random.integers(0, 5), replace=False):
            changed[at] = words(random, 1)[0]
        if i % 10 == 0:
            core = changed
        texts.append((i, " ".join(changed)))
    want = slow_components(texts)
    assert 1 < len(set(want.values())) < 140
    assert components(spark, texts) == want


def test_matches_every_pair_counted(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in rows]
    assert components(spark, texts) == slow_components(texts)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_planted_copies_are_all_found(spark, similarity):
    """Pairs of 12 to 400 words whose resemblance is the least that still counts, or just below."""
    random = np.random.default_rng(9)
    texts, want = [], {}
    for i in range(120):
        n = int(random.integers(12, 400))
        body = words(random, n)
        fewer = next(k for k in range(n - 4) if (n - 5 - k) / (n - 4) < similarity) if i % 2 else int((1 - similarity) * (n - 4) + 1e-9)
        texts += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body[: n - fewer - (i % 2)]))]
        both = len(grams(texts[-1][1]) & grams(texts[-2][1])) / len(grams(texts[-1][1]) | grams(texts[-2][1]))
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + (both < 0.8 - 1e-9)}
    assert components(spark, texts) == want == slow_components(texts)


def test_parities_never_exceed_the_difference():
    random = np.random.default_rng(8)
    for n in (1, 30, 3000, 40000):
        both, a, b = (np.unique(random.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, n // 12 + 1, n // 14))
        x, y = (resemblance.parities(np.union1d(both, z)) for z in (a, b))
        assert len(x) in (len(y), 2 * len(y), len(y) // 2)
        assert resemblance._apart(x, y) <= len(a) + len(b)
    wide = resemblance.parities(both)
    assert (resemblance._folded(wide) == np.packbits((np.bincount((both >> np.uint64(32)).astype(int) % (len(wide) * 32), minlength=len(wide) * 32) & 1).astype(bool), bitorder="little").view(np.uint64)).all()


def test_bounds_rule_out_no_link_and_most_strangers():
    """Of sets of like sizes with a given resemblance, all at 0.8 or more stay open and few below 0.75 do, at any length."""
    random = np.random.default_rng(10)
    for n in (40, 400, 5000, 20000):
        for wanted, least, most in ((0.8, 1, 1), (0.9, 1, 1), (0.72, 0, 0.35), (0.5, 0, 0.05)):
            open_pairs = 0
            for _ in range(10):
                both = int(np.ceil(2 * n * wanted / (1 + wanted)))
                pool = np.unique(random.integers(0, 2**63, 2 * n - both + 50, dtype=np.uint64))
                random.shuffle(pool)
                x, y = pool[:n], np.r_[pool[:both], pool[n : 2 * n - both]]
                bits = np.empty(2, object)
                bits[:] = [resemblance.parities(s).tobytes() for s in (x, y)]
                open_pairs += len(resemblance.Members(np.array([len(x), len(y)]), bits).near(0, np.array([1]), 0.8))
            assert least * 10 <= open_pairs <= most * 10


def test_near_fingerprints_are_joined_first(spark, monkeypatch):
    """Copies whose fingerprints are near come through the embedding, verified, and are not looked for again; the rest is."""
    random = np.random.default_rng(11)
    texts, line = [], words(random, 9)
    for i in range(40):
        body = words(random, 400)
        texts += [(3 * i, " ".join(body)), (3 * i + 1, " ".join([*body, "end"])), (3 * i + 2, " ".join([*body[:360], *words(random, 40)]))]
    texts += [(200 + i, " ".join(line * 40 + words(random, 2))) for i in range(10)]
    named, left = [], []
    near, rest = resemblance._fingerprint_links, resemblance._links

    def first(*args):
        out = near(*args)
        named.extend((r.u, r.v) for r in out[0].collect())
        return out

    def then(texts, cells, described, shingle_words, similarity, found=None):
        left.append(found is not None)
        return rest(texts, cells, described, shingle_words, similarity, found)

    monkeypatch.setattr(resemblance, "_fingerprint_links", first)
    monkeypatch.setattr(resemblance, "_links", then)
    want = slow_components(texts)
    assert components(spark, texts) == want
    assert left == [True] and sum((3 * i, 3 * i + 1) in named for i in range(40)) > 20
    assert all(want[u] == want[v] for u, v in named)


def test_a_part_joined_by_fingerprints_is_tried_by_all_its_members(spark, monkeypatch):
    """Parts of two texts that start joined: another text may resemble only one of them, in a crowded cell."""
    monkeypatch.setattr(resemblance, "DENSE", 2)
    random = np.random.default_rng(12)
    texts, links = [], []
    for f in range(12):
        base = words(random, 204)
        swap = lambda body, at, n: [*body[:at], *words(random, n), *body[at + n :]]
        a, b, c = swap(base, 0, 14), base, swap(base, 190, 14)
        order = (a, b, c) if f % 2 else (b, a, c)
        texts += [(3 * f + i, " ".join(t)) for i, t in enumerate(order)]
        links.append((3 * f, 3 * f + 1))
    want = slow_components(texts)
    assert want == {i: i - i % 3 for i in range(36)}
    inner = resemblance._links

    def started(rows, cells, described, shingle_words, similarity, near=None):
        one = spark.createDataFrame(links, "u long, v long")
        ids = one.selectExpr("explode(array(u, v)) as id")
        return inner(rows, cells, described, shingle_words, similarity, (one, resemblance._sets(rows, ids, shingle_words)))

    monkeypatch.setattr(resemblance, "_links", started)
    assert components(spark, texts) == want
