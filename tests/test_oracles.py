"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

from cloakwork.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        files = f"{path}/*" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(plans.SQL[name])
    types = {c[0]: str(c[1]) for c in found.description}
    columns = [c[0] for c in found.description]
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert sorted(columns) == names and {c: TYPES[df.schema[c].dataType.simpleString()] for c in names} == types
    assert got == want and (got or name in ("entities_email", "merge_without_overlap"))
