import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vellum import runtime

    os.chdir(tmp_path_factory.mktemp("spark"))
    session = runtime.session(4, "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    runtime.ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def same_rows(got, want):
    """got: a Spark DataFrame, want: a pandas one; equal but for the order of rows."""
    import pandas as pd

    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def plain(v):
        if isinstance(v, float):
            return "null" if pd.isna(v) else f"{v:.6f}"
        if v is None or v is pd.NaT:
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(v)

    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.fixture(scope="session")
def compare():
    return same_rows
