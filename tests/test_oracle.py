"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
TABLES = Path("/root/testdata/sf0.001")
if not TABLES.is_dir():
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from listing_lake.plans.registry import ORACLES, QUERIES  # noqa: E402


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    relation = sql.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in at) for row in relation.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
