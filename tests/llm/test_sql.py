"""Registered queries against SQL on another engine."""

import duckdb
import pytest
from landmarq.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name, folder):
    path = f"/root/testdata/{folder}"
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    frame = QUERIES[name](spark, path)
    columns = sorted(frame.columns)
    got = sorted(([r[c] for c in columns] for r in frame.collect()), key=str)
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(([r[names.index(c)] for c in columns] for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:3] == []
