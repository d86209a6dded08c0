import json

from landmarq.llm import chat

CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>, extra int"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"f": {"x": ("number", True), "a": ("string", False), "b": ("array", False)}, "h": {"o": ("object", True), "i": ("integer", False), "t": ("boolean", False)}}


def linked(spark, calls, results=(), schemas=SCHEMAS):
    frame = chat.link_calls(spark.createDataFrame([(*c, 1) for c in calls], CALLS), spark.createDataFrame(list(results), RESULTS), schemas)
    return sorted(frame.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.position))


def test_links_order_and_records(spark):
    rows = linked(
        spark,
        [(1, 1, "a", "f", '{"x":1, "a":"é\\"","b":[1,{"z":2,"y":null}]}', ["b"]), (1, 2, "b", "f", '{"x":1.5}', None), (1, 3, "c", "f", '{"x":"1","w":2}', ["a", "nowhere"])],
        [(1, 4, "a", "first"), (1, 5, "a", "second"), (9, 1, "zz", "lost"), (1, 1, None, None)],
    )
    assert [(r.conv_id, r.call_id, r.position, r.level, r.status, r.errors) for r in rows] == [
        (1, "b", 0, 0, "unanswered", []), (1, "a", 1, 1, "linked", []), (1, "c", 2, 2, "invalid", ["unknown w", "x is no number"]), (1, None, 3, None, "orphan", []), (9, "zz", 0, None, "orphan", []),
    ]
    assert rows[1].record == '{"arguments":{"a":"é\\"","b":[1,{"y":null,"z":2}],"x":1},"content":"first","id":"a","name":"f","status":"linked"}'
    assert all(r.record == json.dumps(json.loads(r.record), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows)


def test_what_is_invalid(spark):
    rows = linked(spark, [
        (1, 1, "a", "f", "{bad", None), (1, 2, "b", "g", "{}", None), (1, 3, "c", "f", "[1]", None), (1, 4, "d", "f", None, None), (1, 5, "e", None, "{}", None), (1, 6, "f", "f", '{"x":1,"x":2}', None),
        (1, 7, "g", "h", '{"o":{},"i":3,"t":true}', None), (1, 8, "h", "h", '{"o":[],"i":3.5,"t":"no"}', None), (1, 9, "i", "f", '{"x":null}', None),
    ])
    assert [r.errors for r in rows] == [
        ["malformed"], ["unknown tool"], ["not an object"], ["malformed"], ["unknown tool"], ["malformed"], [], ["i is no integer", "o is no object", "t is no boolean"], ["missing x"],
    ]


def test_rings_repeats_and_nulls(spark):
    rows = linked(
        spark,
        [(3, 1, "p", "f", '{"x":2}', ["q"]), (3, 2, "q", "f", '{"x":2}', ["p"]), (3, 3, "q", "f", '{"x":2}', None), (3, 4, "r", "f", '{"x":2}', ["q"]), (3, 5, "s", "f", '{"x":2}', ["s"]), (None, None, None, None, None, None)],
        [(3, 9, "s", "ok"), (3, 9, "s", "ok")],
    )
    assert [(r.call_id, r.status, r.level) for r in rows] == [(None, "invalid", 0), ("s", "linked", 0), ("p", "cyclic", None), ("q", "cyclic", None), ("q", "repeated", None), ("r", "cyclic", None)]


def test_order_respects_every_dependency(spark):
    """Random graphs without rings, turns in any order, against the definition."""
    import random

    random.seed(4)
    calls = []
    for conv in range(12):
        names = [f"n{i}" for i in range(8)]
        turns = random.sample(range(50), 8)
        calls += [(conv, turns[i], names[i], "f", '{"x":1}', random.sample(names[:i], min(i, 2))) for i in range(8)]
    rows = linked(spark, calls)
    place = {(r.conv_id, r.call_id): r.position for r in rows}
    assert len(place) == 96
    for conv, _, name, _, _, after in calls:
        assert all(place[conv, a] < place[conv, name] for a in after)


def slow_levels(calls):
    """Longest ways by the definition; None on or behind a ring."""
    after = {c: {a for a in (x or []) if a != c} for c, x in calls}
    after = {c: {a for a in x if a in after} for c, x in after.items()}
    out, left = {}, set(after)
    while free := [c for c in left if not after[c] & left]:
        out |= {c: max((out[a] + 1 for a in after[c]), default=0) for c in free}
        left -= set(free)
    return out | dict.fromkeys(left)


def test_levels_by_the_definition(spark):
    """Random graphs with late waits and rings, some calls of many waits, all conversations levelled."""
    import random

    random.seed(5)
    calls = []
    for conv in range(8):
        n = 30
        for i in range(n):
            pool = range(max(0, i - 6), i) if conv % 2 else range(i)
            after = [f"n{x}" for x in random.sample(list(pool), min(len(pool), random.choice([0, 1, 1, 1, 2, 3])))]
            if conv > 5 and random.random() < 0.3:
                after.append(f"n{random.randrange(n)}")
            calls.append((conv, n - i if i else 99, f"n{i}", "f", '{"x":1}', [*after, "n0"] if i else []))
    got = {(r.conv_id, r.call_id): r.level for r in chat.topological_levels(spark.createDataFrame([(*c, 1) for c in calls], CALLS)).collect()}
    want = {(conv, c): v for conv in range(8) for c, v in slow_levels([(x[2], x[5]) for x in calls if x[0] == conv]).items()}
    assert got == want and None in want.values() and max(v for v in want.values() if v) > 6


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """600 calls one after the other with one late wait, a ring beside them: far fewer tables than calls."""
    written = []
    monkeypatch.setattr(chat, "materialise", lambda df, name, real=chat.materialise: written.append(name) or real(df, name))
    calls = [(1, i, f"c{i:03d}", "f", '{"x":1}', [f"c{i - 1:03d}"] if i > 1 else [] if i else ["c600"], 1) for i in range(601)]
    calls[1] = (1, 1, "c001", "f", '{"x":1}', [], 1)
    calls += [(1, 700, "r1", "f", "{}", ["r2"], 1), (1, 701, "r2", "f", "{}", ["r1"], 1), (1, 702, "r3", "f", "{}", ["r1", "c600"], 1)]
    got = {r.call_id: r.level for r in chat.topological_levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == slow_levels([(c[2], c[5]) for c in calls])
    assert got["c000"] == 600 and got["r3"] is None
    assert written.count("free") < 16


def test_conversations(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    turns = {(r.conv_id, r.turn): r for r in conversations.collect()}
    calls, results = chat.calls_from_turns(conversations)
    schema = {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}}
    rows = chat.link_calls(calls, results, schema).collect()
    assert len(rows) == sum(r.role == "user" for r in turns.values())
    for r in rows:
        asked, answer = turns[r.conv_id, r.turn], turns.get((r.conv_id, r.turn + 1))
        answered = answer is not None and answer.role == "assistant"
        assert r.status == ("linked" if answered else "unanswered")
        want = {"arguments": {"text": asked.text, "turn": asked.turn, "words": len(asked.text.split())}, "content": answer.text if answered else None, "id": f"{r.conv_id}:{r.turn}", "name": "reply", "status": r.status}
        assert json.loads(r.record) == want
    for conv in {r.conv_id for r in rows}:
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and [r.turn for r in own] == sorted(r.turn for r in own)


def test_empty_and_python_free(spark):
    empty = linked(spark, [])
    assert empty == []
    calls, results = chat.calls_from_turns(spark.createDataFrame([(None, None, None, None), (1, None, "user", "x"), (1, 0, "user", None), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string"))
    frame = chat.link_calls(calls, results, {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}})
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    assert [(r.conv_id, r.turn, r.status) for r in frame.collect()] == [(1, 0, "linked")]
