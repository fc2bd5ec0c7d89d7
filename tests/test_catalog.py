"""Every registered trace query against its SQL in DuckDB."""

import duckdb
import pytest

from traceloom import catalog

TABLES = "events conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple("" if r[i] is None else round(float(r[i]), 5) if isinstance(r[i], (int, float)) else str(r[i]) for i in order))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = plain([tuple(r) for r in df.collect()], df.columns), plain(cur.fetchall(), names)
    if name == "heavy_hitters":  # ties at the edge are ordered by list in SQL too
        assert [r[0] for r in got] == [r[0] for r in want]
    assert got == want


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, sf).columns
