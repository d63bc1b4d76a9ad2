"""Every query with a SQL counterpart against DuckDB, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from isobar.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> Counter:
    def plain(v):
        if isinstance(v, (list, dict, str, bytes)):
            return str(v)
        if pd.isna(v):
            return None
        return float(f"{float(v):.8g}") if isinstance(v, (int, float, np.number, np.bool_)) else v

    return Counter(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_ring_gradient_everywhere_has_every_cell(spark, data):
    from isobar.plans.adapters import field

    assert QUERIES["ring_gradient_everywhere"](spark, data).count() == field(spark, data).count()


def test_extreme_location_grid_all_has_five_extremes(spark, data):
    assert {r["extreme"] for r in QUERIES["extreme_location_grid_all"](spark, data).select("extreme").collect()} == {"max_uv", "max_dpdt", "max_depth", "min_p", "max_dsqp"}
