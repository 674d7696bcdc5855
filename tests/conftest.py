import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corvidex.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value.tolist() if hasattr(value, "tolist") else value


def compare(spark, sf_dir, query, sql):
    """Asserts that a query and its SQL give the same rows, in any order."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(repr([None if v is None or v is pd.NaT else plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(a) == rows(b)
