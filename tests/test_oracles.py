"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pandas as pd
import pytest

from plotline.plans.demo import BASE
from plotline.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def text(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = queries()[name](spark, DATA)
    want = duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    floats = lambda f: [[(round(float(x), 6) if re.fullmatch(r"-?\d+(\.\d+)?", x) else x) for x in r] for r in rows(f)]
    assert sorted(map(str, floats(got.toPandas()))) == sorted(map(str, floats(want)))
