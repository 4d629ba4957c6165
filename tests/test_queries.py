"""Every registered query against its SQL, on whole small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.conftest import SMALL
from veilframe import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1)
    text = lambda v: "NULL" if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v) else repr(float(v)) if isinstance(v, float | np.floating) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
