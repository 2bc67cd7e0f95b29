"""Every catalogue query with SQL against DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def bag(df: pd.DataFrame) -> Counter:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return Counter(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want, got = db.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert len(got) and bag(got) == bag(want)
