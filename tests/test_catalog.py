"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from furrow import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plain(v):
    return float(f"{v:.8g}") + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert rows
    if name in catalog.ORACLE_SQL:
        out = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(out.columns) == cols
        at = [out.columns.index(c) for c in cols]
        want = [tuple(plain(r[k]) for k in at) for r in out.fetchall()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_season_integral_has_its_known_sum(spark):
    rows = catalog.QUERIES["auc_trapezoid"](spark, SF).collect()
    assert len(rows) == 561 and sum(r["auc"] is not None for r in rows) == 436
    assert sum(r["auc"] or 0 for r in rows) == pytest.approx(112218.286388, abs=1e-4)


def test_fusion_has_its_known_lags(spark):
    rows = catalog.QUERIES["fuse_nearest"](spark, SF).where("mean is not null").collect()
    assert len(rows) == 240 and sum(r["date_lag_days"] for r in rows) == 530
