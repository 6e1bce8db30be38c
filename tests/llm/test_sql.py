"""The queries that have SQL, against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from lodestone.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 3) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = con.execute(queries.ORACLES[name])
    names = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, df.collect())
    assert got and got == rows(names, out.fetchall())
