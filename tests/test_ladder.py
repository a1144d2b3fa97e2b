"""Whole strategies, the traded ladder, and checks as bundles."""

from pyspark.sql import functions as F

from edgelab.governance import TrialRegister
from edgelab.operators import account, checks, execution, figures, funding, indicators, inference, sessions
from edgelab.plans import ladder, registry
from edgelab.sources import bars as src

SF = "/root/testdata/sf0.001"
FEW = {"s2t1": (2.0, 1.0, False), "flip0": (None, None, True)}


def test_run_splits_trades_by_entry(spark):
    bars = registry._hourly(spark, SF)
    stats, days = ladder.run(bars, ladder.cross_strategy(3, 8), 0.1, 5.0, presets=FEW)
    rows = stats.collect()
    assert {r.cfg for r in rows} <= set(FEW) and {r.part for r in rows} == {"train", "test"}
    test_n = sum(r.n for r in rows if r.part == "test")
    assert days.count() == test_n and days.filter("exit_order < 1 or mae < 0").count() == 0
    base, _ = ladder.run(bars, ladder.base_strategy, 0.1, 5.0, presets=FEW)
    assert base.columns == stats.columns


def test_account_phase_needs_enough_trades(spark):
    stats = spark.createDataFrame([("x", "a", "test", 30), ("x", "b", "test", 3)], "symbol string, cfg string, part string, n long")
    days = spark.createDataFrame([("x", c, f"d{k}", 1, 400.0 if k % 2 else -300.0, 300.0) for c in "ab" for k in range(10)], "symbol string, cfg string, day string, exit_order long, pnl double, mae double")
    calendar = spark.createDataFrame([(f"d{k}",) for k in range(14)], "day string")
    rule = funding.RULES["TOPSTEP_COMBINE_50K"]
    assert ladder.account_phase(stats, days, calendar, rule, "x", "b") is None
    got = ladder.account_phase(stats, days, calendar, rule, "x", "a", 500)
    assert got.agg(F.sum("accounts")).first()[0] == 500


def test_ladder_stops_early_and_tells(spark):
    grouped = sessions.session_groups(registry._hourly(spark, SF).filter("symbol = 'click'"))
    told = []
    p = ladder.ladder(grouped, ladder.cross_strategy(3, 8), "crosses", 0.1, 3, 60, 40, least=10_000, log=told.append)
    assert p.climb() == "REJECTED" and len(p.seen) == 1 and "needed" in told[0]
    p = ladder.ladder(grouped, ladder.cross_strategy(3, 8), "crosses", 0.1, 3, 60, 40, least=1)
    assert p.climb() == "REJECTED" and p.seen[0][1] == "pass" and "of 3 draws" in p.seen[1][2]  # with 3 draws p can't be below .25


def test_grid_is_registered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(execution, "exit_grid", lambda: FEW)
    f = registry._features(spark, SF)
    register = TrialRegister(spark, f"file://{tmp_path}/register")
    best = ladder.grid_with_register(f, f.select("symbol", "i", "close"), 0.1, register, "grid", "2024-01-01", 1)
    assert best.count() >= 1 and register.trials().count() == 2 and register.matrix("train").count() > 0


def test_check_bundle(spark):
    fine = registry._hourly(spark, SF)
    daily = src.event_bars(spark, SF, 86400)
    got = checks.check_bundle(daily, indicators.atr(daily), fine, 86400).collect()
    assert {r.name for r in got} == {"nulls", "insane", "duplicates", "odd_gaps", "zero_volume", "jumps", "splices", "empty", "different"}
    assert all(r.verdict == "pass" for r in got if r.name in ("empty", "different", "nulls"))


def test_metrics_and_figures(spark):
    x = spark.createDataFrame([(c, t, float((t * c) % 7 - 3)) for c in range(1, 5) for t in range(40)], "cfg int, t int, pnl double")
    sums, combos = inference.block_sums(x, 4), inference.combinations(spark, 4)
    assert inference.cscv_splits(sums, combos, "mean").count() == 6
    h = figures.histogram(x, ["cfg"], "pnl", 3)
    assert h.agg(F.sum("n")).first()[0] == 160 and h.filter("bin < 0 or bin > 2").count() == 0
    flat = figures.histogram(x.withColumn("pnl", F.lit(1.0)), ["cfg"], "pnl", 3).collect()
    assert all(r.bin == 0 and r.n == 40 for r in flat)
    trades = spark.createDataFrame([(1, 5.0, 1.2, 7.9), (1, -2.0, 2.6, 0.4)], "cfg int, pnl double, mae double, mfe double")
    assert {(r.won, r.mae, r.mfe) for r in figures.excursions(trades, ["cfg"], 1.0).collect()} == {(True, 1.0, 7.0), (False, 2.0, 0.0)}
    days = spark.createDataFrame([(1, 100.0, -10.0), (2, -50.0, None)], "day int, gain double, low double")
    got = ladder.evaluations(lambda limit: days, sims=100)
    assert len(got) == 9 and account.barrier_pass(3000, 2000) == 0.4
