"""Every query of the library against its DuckDB counterpart, and again with the input rows in another order."""

import duckdb
import pandas as pd
import pytest

from factweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else getattr(v, "item", lambda: v)()
    return list(frame.columns), sorted(repr([clean(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_oracle(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())
