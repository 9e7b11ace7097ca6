"""Every registered query with a SQL twin gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from locusframe.plans.catalog import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None or b is None) and a is b or a is not None and b is not None and math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-6)
    return a == b


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = order(tuple(r) for r in df.select(*columns).collect())
    result = con.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    wanted = order(tuple(r[i] for i in at) for r in result.fetchall())
    assert len(found) == len(wanted)
    assert all(same(x, y) for a, b in zip(found, wanted, strict=True) for x, y in zip(a, b, strict=True))


