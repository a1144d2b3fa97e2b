"""Registered queries against their SQL on made tables with prices that the given ones have seldom or never."""

import datetime as dt
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from edgelab.plans import registry


def made(tmp_path, series):
    """A folder with an events table of three ticks an hour; series: {symbol: prices}."""
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * k), symbol, float(v)) for symbol, prices in series.items() for k, v in enumerate(prices)]
    f = pd.DataFrame(rows, columns=["ts", "event_type", "value"])
    f = f.assign(event_id=range(len(f)), user_id=[k % 7 for k in range(len(f))], props=[f'{{"k": {k % 90}}}' for k in range(len(f))])
    c = duckdb.connect()
    c.execute(f"copy (select event_id::bigint event_id, ts::timestamp ts, user_id::bigint user_id, event_type, value, props from f) to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    return c


def same_as_sql(spark, sf_dir, name, keys):
    """Both results in the same order, with equal keys."""
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    a, b = registry.QUERIES[name](spark, sf_dir).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and (a[keys] == b[keys]).all(axis=None)
    return a.drop(columns=keys), b.drop(columns=keys)


def test_permuted_bars_with_prices_of_zero(spark, tmp_path):
    rng = np.random.default_rng(5)
    series = {name: np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, 216))), 2) for name in ("plain", "low", "close", "last", "first", "flat")}
    for name, places in {"low": [100], "close": [101], "last": [215], "first": [0], "flat": [99, 100, 101]}.items():
        series[name][places] = 0.0
    sql = made(tmp_path, series).execute(registry.ORACLE_SQL["permuted_bars"]).df().set_index(["perm", "symbol"]).sort_index()
    got = registry.QUERIES["permuted_bars"](spark, str(tmp_path)).toPandas().set_index(["perm", "symbol"]).sort_index()
    assert len(got) == 6 * 301 and got.index.equals(sql.index) and (got["bars"] == sql["bars"]).all()
    for column in ("path", "span", "dealt"):
        assert np.isclose(got[column].to_numpy(float), sql[column].to_numpy(float), rtol=0, atol=2e-3, equal_nan=True).all(), column
    assert math.isinf(got["span"][3, "low"]) and math.isfinite(got["path"][3, "low"])


def test_rounding_is_that_of_the_sql(spark):
    x = [s * a / (b / n) for a in (87, 159, 77, 205) for b in (320, 640, 7) for n in (1, 3, 7) for s in (1, -1)] + [0.5e-5, 1.5e-5, 1e303, -1e304, 123456789012.34567, math.inf, -math.inf, math.nan, None]
    got = [r.x for r in registry._rounded(spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)).collect()]
    want = [duckdb.execute("select round(?::double, 5)", [v]).fetchone()[0] for v in x]
    assert [repr(v + 0.0) if v is not None else None for v in got] == [repr(v + 0.0) if v is not None else None for v in want]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_path_conditioners_equal_their_sql_to_the_last_digit(spark):
    a, b = same_as_sql(spark, "/root/testdata/sf0.01", "path_conditioners", ["symbol", "i"])
    assert np.isclose(a.to_numpy(float), b.to_numpy(float), rtol=0, atol=1e-9, equal_nan=True).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_sharpe_ratios_have_all_digits_of_their_sql(spark):
    a, b = same_as_sql(spark, "/root/testdata/sf0.001", "sharpe_ratios", ["cfg", "n"])
    assert len(a) == 9 and np.isclose(a.to_numpy(float), b.to_numpy(float), rtol=0, atol=1e-9, equal_nan=True).all()
