"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chronoframe.catalog import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(frame, columns):
    out = [tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)]
    key = lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else 0.0, x if isinstance(x, str) else "") for x in r)
    return sorted(out, key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.toPandas()
    if name not in ORACLE_SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not wrong, wrong[:3]
