import random

from landmarq.llm.components import connected_components


def slow(pairs):
    names = {}
    for u, v in pairs:
        names.setdefault(u, u), names.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            least = min(names[u], names[v])
            if names[u] != least or names[v] != least:
                names[u] = names[v] = least
                changed = True
    return names


def test_matches_brute_force(spark):
    random.seed(3)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(120)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    real = [(u, v) for u, v in pairs if u != v]
    frame = spark.createDataFrame([*pairs, (None, 3), (4, None)], "u long, v long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == slow(real)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
