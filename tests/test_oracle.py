"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from claimlab.plans.catalog import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, str(SF))
    cur = db.execute(ORACLE[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    got = QUERIES[name](spark, str(SF))
    found = got.collect()
    assert got.columns and (found or name == "manifest_verify")
    assert not any(isinstance(v, float) and math.isnan(v) for r in found for v in r)
