"""Registered queries against their SQL in another engine, on the smallest tables."""

import math
import os

import duckdb
import pytest

from edgelab.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = """
hourly_bars coarser_bars merged_duplicates window_indicators scan_indicators super_trend event_information forward_outcomes session_vwap
causal_bands band_race swing_levels volume_profiles permuted_bars variance_ratio backtest_overfitting luck_battery runs_test
bar_checks order_flow indicator_signals directional_movement regimes base_entries ichimoku_information cross_filters separated_entries
anchored_bands band_races confluence bucket_races touch_then_cross session_profiles tick_value_areas session_levels level_breaks
path_conditioners fade_economics trailing_trades follow_the_cross merged_order_flow trade_dependence month_table parameter_plateau order_checks
""".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 4) + 0.0 if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, duck, name):
    a, b = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(registry.ORACLE_SQL[name]).df())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-4))
