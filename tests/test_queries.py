"""Every registered monitoring query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def _rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) else str(v)

    return sorted(([plain(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    assert _rows(catalog.queries()[name](spark, SF).toPandas()) == _rows(db.execute(catalog.oracle_sql()[name]).df())
