"""Every query with SQL gives the same rows as DuckDB; the others give rows of a stable schema."""

import math
import os

import duckdb
import pytest

from gleanery import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    frame = plans.queries()[name](spark, SF)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name in plans.oracle_sql():
        wanted = duck.sql(plans.oracle_sql()[name])
        assert sorted(wanted.columns) == sorted(frame.columns)
        assert got == rows(wanted.columns, wanted.fetchall())
