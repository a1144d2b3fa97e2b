import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgelab import governance
from edgelab.operators import account, kernels
from edgelab.plans import registry


def bars(rows):
    f = pd.DataFrame(rows, columns=["open", "high", "low", "close"])
    return f.assign(symbol="x", i=range(len(f)), atr=1.0, long=[True] + [False] * (len(f) - 1), short=False, in_window=True, trend_up=True)


def test_stop_comes_before_target():
    t = kernels.simulate_series(bars([(10, 10, 10, 10), (10, 14, 7, 10), (10, 10, 10, 10)]), {"C": (2.0, 3.0, False)}, 0.0)
    assert t["reason"].tolist() == ["stop"] and t["exit_px"].tolist() == [8.0] and t["mfe"].tolist() == [4.0]


def test_gap_fills_at_the_open_and_window_end_is_flat():
    t = kernels.simulate_series(bars([(10, 10, 10, 10), (6, 7, 5, 6), (6, 6, 6, 6)]), {"C": (2.0, 3.0, False)}, 0.5)
    assert t["exit_px"].tolist() == [6.0] and t["pnl"].tolist() == [-4.5]
    t = kernels.simulate_series(bars([(10, 10, 10, 10), (10, 10, 10, 10), (10, 11, 10, 11)]), {"A": (None, None, False)}, 0.0)
    assert t["reason"].tolist() == ["flat"] and t["pnl"].tolist() == [1.0]


def test_reverse_and_flip():
    f = bars([(10, 10, 10, 10)] * 4)
    f["short"] = [False, True, False, False]
    t = kernels.simulate_series(f, {"A": (None, None, False)}, 0.0)
    assert t["reason"].tolist() == ["reverse", "flat"] and t["direction"].tolist() == [1, -1]
    f = bars([(10, 10, 10, 10)] * 4).assign(trend_up=[True, False, True, True])
    assert kernels.simulate_series(f, {"A": (None, None, True)}, 0.0)["reason"].tolist() == ["flip"]


def test_accounts_near_the_closed_form():
    pool = [[(50.0, 0.0)], [(-50.0, 0.0)]]
    status, _ = account.evaluation(pool, {"mll": 1000.0, "lock": -1000.0, "target": 1500.0, "realtime": True}, 3000, 5, 20_000)
    assert abs((status == 1).mean() - account.barrier_pass(1500, 1000)) < 0.03


def trade_by_trade(day, balance, floor, dll):
    """Gain of a day and whether the floor broke, one trade after the other."""
    gain = 0.0
    for pnl, adverse in day:
        if dll is not None and gain <= -dll:
            break
        if balance + gain - adverse <= floor or balance + gain + pnl <= floor:
            return gain, True
        gain += pnl
    return gain, False


@pytest.mark.parametrize("dll", [None, 60.0])
def test_day_results_say_as_much_as_the_trades(spark, dll):
    rng = np.random.default_rng(3)
    pool = [[(float(p), float(max(-p, 0) + a)) for p, a in zip(rng.normal(0, 40, n), rng.exponential(10, n))] for n in rng.integers(1, 9, 30)] + [[]]
    trades = spark.createDataFrame([(d, k, p, a) for d, b in enumerate(pool) for k, (p, a) in enumerate(b)], "day int, exit_order long, pnl double, mae double")
    found = {r["day"]: r for r in account.day_results(spark.range(len(pool)).select(F.col("id").cast("int").alias("day")), trades, dll).collect()}
    assert len(found) == len(pool)
    for d, day in enumerate(pool):
        for balance, floor in [(0.0, -50.0), (0.0, -120.0), (30.0, 0.0), (500.0, 0.0)]:
            gain, broke = trade_by_trade(day, balance, floor, dll)
            low = found[d]["low"]
            assert (low is not None and balance + low <= floor) == broke
            assert broke or found[d]["gain"] == pytest.approx(gain)


def test_accounts_draw_from_all_trades(spark, tmp_path):
    """No supplier number here is a multiple of 20; every day wins."""
    rows = [(k, 1 + k % 19, dt.datetime(2024, 1, 1 + k % 10), 10_000.0, 0.15) for k in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["status"]: r["accounts"] for r in registry.QUERIES["account_evaluation"](spark, str(tmp_path)).collect()}
    assert found == {0: 0, 1: 8_000, 2: 0}


def test_inference_queries_have_the_reference_sizes(spark):
    """p-values can fall to 1/301, and all 12,870 splits of 16 blocks count."""
    found = registry.QUERIES["family_pvalues"](spark, "/root/testdata/sf0.001").first()
    assert found["permutations"] == 300 and found["p_max"] >= 1 / 301 - 1e-5
    got = registry.QUERIES["backtest_overfitting_full"](spark, "/root/testdata/sf0.001").first()
    t = pd.read_parquet("/root/testdata/sf0.001/lineitem.parquet")
    t = t.assign(pnl=t.l_extendedprice * (t.l_discount - 0.05), cfg=t.l_suppkey % 9, t=(t.l_shipdate.dt.year - 1995) * 12 + t.l_shipdate.dt.month - 1)
    m = t.groupby(["cfg", "t"]).pnl.sum().unstack(0)
    size = (int(t.t.max()) + 1) // 16
    blocks = [m[(m.index >= k * size) & (m.index < (k + 1) * size)] for k in range(16)]
    n, x, xx = (np.array([f(b) for b in blocks]) for f in (lambda b: b.count(), lambda b: b.sum(), lambda b: (b * b).sum()))
    below, best = 0, []
    for c in itertools.combinations(range(16), 8):
        sides = []
        for side in (list(c), [k for k in range(16) if k not in c]):
            a, b, d = n[side].sum(0), x[side].sum(0), xx[side].sum(0)
            sides.append(b / a / np.sqrt((d - b * b / a) / (a - 1)))
        w = int(np.argmax(sides[0]))
        best.append(sides[0][w])
        below += (sides[1] <= sides[1][w]).sum() / 10 <= 0.5
    assert got["combinations"] == 12_870 == len(best)
    assert got["pbo"] == pytest.approx(below / 12_870, abs=1e-4) and got["is_median"] == pytest.approx(np.median(best), abs=1e-4)


def test_slippage_and_folds_and_ledger_rules():
    assert account.slippage_ticks(3) == pytest.approx(0.55) and account.slippage_ticks(100) == pytest.approx(2.0 + 50 * 0.8 / 30)
    assert governance.walk_forward(100, 40, 30) == [(0, 40, 40, 70), (30, 70, 70, 100)]
    assert governance.ladder([("a", "pass"), ("b", "skip"), ("c", "warn")]) == "INCOMPLETE"
    assert governance.information_verdict(0.01, 1.0, True) == "SIGNAL ONLY"
    with pytest.raises(ValueError):
        governance.check_hypothesis({"title": "x"})


def test_holdout_opens_once(spark):
    s = governance.Split(100, embargo=2)
    b = spark.range(100).withColumnRenamed("id", "i")
    assert s.bounds()["train"] == (0, 58)
    with pytest.raises(PermissionError):
        s.holdout(b, "short")
    assert s.holdout(b, "the final look at the holdout").count() == 20
    with pytest.raises(PermissionError):
        s.holdout(b, "another look at the same holdout")
