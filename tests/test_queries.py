"""Every registered query of the core against its SQL."""

import duckdb
import pytest

from maskwell.plans import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return c


def _rows(rows, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    got = _rows([r.asDict() for r in df.collect()], sorted(names))
    assert got == _rows(want, sorted(names)) and got


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(SQL)
