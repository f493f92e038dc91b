"""Each query against its SQL in DuckDB on the smallest tables; those without SQL give rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from larkspan.plans import catalog


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or pd.isna(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else float(x)
    return int(x) if isinstance(x, np.integer) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf_dir, duck):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
