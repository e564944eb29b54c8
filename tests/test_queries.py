"""Every registered query against its SQL at the smallest size."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from satloom.plans import files, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


def plain(x):
    if x is None or x is getattr(__import__("pandas"), "NA", None):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    return str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        assert rows(got) == rows(duck.execute(registry.SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
