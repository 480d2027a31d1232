"""Every catalogue query against its SQL twin in another engine, at the smallest scale."""

import math

import duckdb
import pytest

from morphloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    if type(value).__name__ == "Decimal":
        return round(float(value), 4)
    return value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    columns = sorted(got.columns)
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cursor.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    if have != want:
        assert len(have) == len(want)
        for a, b in zip(have, want):
            assert all(x == y or (isinstance(x, (int, float)) and y is not None and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)
