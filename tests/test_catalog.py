"""Every named query on the smallest tables: it runs, and equals its DuckDB SQL."""

import os

import numpy as np
import pytest

from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return "null"
    if isinstance(value, (float, np.floating)):
        return f"{float(value):.4f}"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = df.toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
        return
    expected = duck.execute(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    for c in found.columns:  # integers may have become floats where there are nulls
        if found[c].dtype.kind == "f" and expected[c].dtype.kind in "iu":
            expected[c] = expected[c].astype(float)
        if expected[c].dtype.kind == "f" and found[c].dtype.kind in "iu":
            found[c] = found[c].astype(float)
    assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
