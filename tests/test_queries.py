"""Every query with SQL against that SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import queries

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)[:19] if hasattr(v, "year") else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == cols
        assert got == sorted(repr(tuple(map(plain, r))) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).columns == ["order_key", "line_no", "score", "n_findings"]
