"""Every query against its SQL in DuckDB, on the smallest data."""

import math

import duckdb
import pytest

from tidebook import plans

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=lambda r: [(x is None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


def test_every_query_is_documented():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    without = set(plans.QUERIES) - set(plans.ORACLES)
    assert without == {"ewma_fair", "refresh_triggers", "model_quotes", "hedge_fires", "queue_tracker",
                       "hmm_filter", "ofi_pca", "ofi_integrated", "calibration_by_rank"}
