"""Governance, sinks and stream states."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgelab import governance
from edgelab.operators import checks, families, inference, sessions, signals
from edgelab.plans import registry
from edgelab.sources import bars as src
from edgelab.sources import sinks
from edgelab.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def test_holdout_stays_spent_for_another_process(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("i"))
    path = f"file://{tmp_path}/looks"
    governance.Split(100, ledger=path).holdout(df, "the study's final and only look")
    with pytest.raises(PermissionError, match="spent"):
        governance.Split(100, ledger=path).holdout(df, "another process looks again at it")
    with pytest.raises(PermissionError, match="20"):
        governance.Split(100).holdout(df, "short")


def test_ledgers_append_once(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ledger", spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int")
    assert governance.append_new(spark, path, rows) == 2 and governance.append_new(spark, path, rows) == 0
    assert governance.read_ledger(spark, f"{path}-none", "id string").count() == 0


def test_trial_register_keeps_the_usual_length(spark, tmp_path):
    r = governance.TrialRegister(spark, f"file://{tmp_path}/register")
    pnl = lambda n, k: spark.range(n).select(F.col("id").cast("int").alias("t"), (F.col("id") * k).cast("double").alias("pnl"))
    a = r.record("one", {"n": 1}, "train", "2024-01-01", pnl(10, 1))
    b = r.record("one", {"n": 2}, "train", "2024-01-02", pnl(10, 2))
    r.record("one", {"n": 3}, "train", "2024-01-03", pnl(7, 3))
    assert r.record("one", {"n": 1}, "train", "2024-01-04", pnl(10, 5)) == a
    m = r.matrix("train").toPandas()
    assert set(m.cfg) == {a, b} and len(m) == 20 and m[(m.cfg == a) & (m.t == 2)].pnl.tolist() == [10.0] and r.trials().count() == 3


def test_protocol_stops_at_the_first_failure(spark, tmp_path):
    seen = []
    rung = lambda name, state: (name, lambda: (seen.append(name), (state, f"{name} was {state}"))[1])
    p = governance.Protocol("study", [rung("a", "pass"), rung("b", "warn"), rung("c", "fail"), rung("d", "pass")])
    assert p.climb() == "REJECTED" and seen == ["a", "b", "c"] and "not reached" in p.report()
    p.save(spark, f"file://{tmp_path}/out")
    assert "REJECTED" in spark.read.text(f"file://{tmp_path}/out/result.json").first()[0]
    assert governance.Protocol("s", [rung("a", "pass"), rung("b", "warn")]).climb() == "PASSED WITH WARNINGS"
    assert governance.Protocol("s", [rung("a", "pass"), rung("b", "skip")]).climb() == "INCOMPLETE"


def test_verdicts_name_a_configuration_only_for_an_edge(spark, tmp_path):
    gates = [("information", "pass", ""), ("permutation", "fail", "p was 0.4 of the draws"), ("costs", "fail", "net is below zero")]
    v = governance.Verdict.of_gates("x", gates, "cfg", "1.0")
    assert (v.state, v.config) == ("NO EDGE", "") and "permutation" in v.reason and v.evidence == ("costs: net is below zero",)
    assert governance.Verdict.of_gates("x", gates[:1], "cfg", "1.0").state == "EDGE"
    for state, config in (("NO EDGE", "cfg"), ("EDGE", "")):
        with pytest.raises(ValueError):
            governance.Verdict("x", state, "a reason that is long enough", config, config)
    path = f"file://{tmp_path}/verdicts"
    spark.createDataFrame([("a", 0.2, 1.0, True), ("b", 0.01, 3.0, True), ("c", 0.01, 1.5, True)], "name string, p_max double, peer_ratio double, others_agree boolean").write.json(path)
    assert [v.state for v in governance.replay(spark, path)] == ["NO EDGE", "INCONCLUSIVE", "SIGNAL ONLY"]
    row = registry.QUERIES["backtest_overfitting"](spark, SF).first().asDict()
    assert "Probability of overfitting" in governance.overfitting_report(row)


def test_declared_segments_leave_a_session_out(spark):
    rows = [("x", i, f"2024-06-{27 + i:02d}" if i < 4 else f"2024-07-{i - 3:02d}") for i in range(8)]
    got = {r.session: r.segment for r in governance.declared_segments(spark.createDataFrame(rows, "symbol string, i int, session string")).collect()}
    assert got["2024-06-29"] == "train" and got["2024-06-30"] is None and got["2024-07-01"] == "validate"


def test_sinks_can_run_again(spark, tmp_path):
    base = f"file://{tmp_path}"
    flow = checks.order_flow(checks.quotes(src.event_ticks(spark, SF)))
    for _ in range(2):
        sinks.write_order_flow(flow, f"{base}/flow")
    back = spark.read.parquet(f"{base}/flow")
    assert back.count() == flow.count() and {"symbol", "date"} <= set(back.columns)
    raw = spark.createDataFrame([("x", 60 * (k // 2), k, 1.0, 2.0, 0.5, 1.5, 10.0) for k in range(20)], "symbol string, ts long, seq long, open double, high double, low double, close double, volume double")
    assert sinks.repair(raw, f"{base}/bars", {"1m": 60, "5m": 300}).first().merged == 10
    assert spark.read.parquet(f"{base}/bars").filter("tf = '5m'").agg(F.sum("volume")).first()[0] == 200.0
    rows = spark.createDataFrame([("x", d, float(d)) for d in range(5)], "symbol string, day int, poc double")
    assert sinks.append_missing(rows.filter("day < 3"), f"{base}/profiles", ["symbol", "day"]) == 3
    assert sinks.append_missing(rows, f"{base}/profiles", ["symbol", "day"]) == 2 and spark.read.parquet(f"{base}/profiles").count() == 5
    sinks.write_results(f"{base}/study", rows, rows, {"p": 0.5})
    cells, statistics, summary = sinks.read_results(spark, f"{base}/study")
    assert cells.count() == statistics.count() == 5 and summary == {"p": 0.5}
    rows.write.option("header", "true").csv(f"{base}/csv")
    assert sinks.read_csv_results(spark, f"{base}/csv", "symbol string, day int, poc double").agg(F.sum("poc")).first()[0] == 10.0
    t = sinks.tensor(rows, ["symbol", "day"], "poc")
    assert {(r.symbol_at, r.day_at) for r in t.collect()} == {(0, d) for d in range(5)}


def test_delimited_bars_and_quotes(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ts,open,high,low,close,volume\n1704067200,1,2,0.5,1.5,10\n1704067140,1,1,1,1,1\n")
    got = src.read_csv_bars(spark, f"file://{tmp_path}/b.csv").orderBy("i").collect()
    assert [r.ts for r in got] == [1704067140, 1704067200] and str(got[1].dt) == "2023-12-31 18:00:00"
    (tmp_path / "q20240102.csv").write_text("638000000000000000;1;0;100.25;3;1;1\nbroken\n")
    q = src.read_quotes(spark, f"file://{tmp_path}/q20240102.csv").collect()
    assert q[0].price == 100.25 and q[1].price is None and q[0].day == "20240102"


def run_stream(spark, pdf, schema, make, tmp_path, name):
    """The rows that a stream over three files makes, in order of time."""
    folder = tmp_path / name
    df = spark.createDataFrame(pdf, schema)
    n = len(pdf) // 3 + 1
    for k in range(3):
        spark.createDataFrame(pdf.iloc[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    out = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}-state").start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).toPandas()


BARS = "symbol string, session string, slot int, time timestamp, open double, high double, low double, close double, volume double"


def bars(n=60):
    rng = np.random.default_rng(1)
    c = 100 + rng.normal(size=n).cumsum()
    return pd.DataFrame({"symbol": "x", "session": [f"s{k // 20}" for k in range(n)], "slot": [k % 2 for k in range(n)], "time": pd.date_range("2024-01-01", periods=n, freq="h"), "open": c, "high": c + rng.random(n), "low": c - rng.random(n), "close": c, "volume": rng.random(n) * 10})


def test_stream_states_equal_batch(spark, tmp_path):
    p = bars()
    sort = lambda x: x.sort_values("time").reset_index(drop=True)
    roll = sort(run_stream(spark, p, BARS, lambda s: stream.stream_rolling(s, 5), tmp_path, "roll"))
    assert np.allclose(roll.roll_high[4:], p.high.rolling(5).max()[4:]) and np.allclose(roll.roll_mean[4:], p.close.rolling(5).mean()[4:]) and roll.roll_low[:4].isna().all()
    vwap = sort(run_stream(spark, p, BARS, stream.stream_session_vwap, tmp_path, "vwap"))
    tp = (p.high + p.low + p.close) / 3
    want = (tp * p.volume).groupby(p.session).cumsum() / p.volume.groupby(p.session).cumsum()
    assert np.allclose(vwap.vwap, want)
    z = sort(run_stream(spark, p, BARS, lambda s: stream.stream_slot_z(s, "volume", 5), tmp_path, "slotz"))
    for k in (20, 59):
        earlier = p.volume[: k][p.slot[:k] == p.slot[k]]
        assert math.isclose(z.z[k], (p.volume[k] - earlier.mean()) / earlier.std(ddof=1))
    trend = sort(run_stream(spark, p, BARS, lambda s: stream.stream_trend(s, 10, 3.0), tmp_path, "trend"))
    from edgelab.operators import indicators

    batch = indicators.super_trend(spark.createDataFrame(p.assign(i=range(len(p))))).orderBy("i").toPandas()
    assert np.allclose(trend.super_trend, batch.super_trend) and trend.super_trend_up.tolist() == batch.super_trend_up.tolist()
    kama = sort(run_stream(spark, p, BARS, stream.stream_kama, tmp_path, "kama"))
    value = p.close[0]
    for k in range(1, len(p)):
        path = p.close[max(0, k - 10) : k + 1].diff().abs().sum()
        er = abs(p.close[k] - p.close[k - 10]) / path if k >= 10 and path > 0 else 0.0
        value += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (p.close[k] - value)
    assert math.isclose(kama.kama.iloc[-1], value)
    ema = sort(run_stream(spark, p, BARS, lambda s: stream.stream_ema(s.select("symbol", "time", "close"), 9), tmp_path, "ema"))
    assert np.allclose(ema.ema, p.close.ewm(span=9, adjust=False).mean())


def test_stream_bars_and_merged_duplicates(spark, tmp_path):
    t = pd.DataFrame({"symbol": "x", "time": pd.date_range("2024-01-01", periods=90, freq="4min"), "seq": range(90), "price": np.arange(90.0), "size": 1.0})
    got = run_stream(spark, t, "symbol string, time timestamp, seq long, price double, size double", stream.stream_bars, tmp_path, "sbars").sort_values("time")
    assert got.open.tolist()[:3] == [0.0, 15.0, 30.0] and got.close.tolist()[:2] == [14.0, 29.0] and (got.volume[:3] == 15).all()
    d = pd.DataFrame({"symbol": "x", "time": np.repeat(pd.date_range("2024-01-01", periods=30, freq="h"), 2), "seq": range(60), "open": np.arange(60.0), "high": np.arange(60.0) + 1, "low": np.arange(60.0) - 1, "close": np.arange(60.0), "volume": 1.0})
    got = run_stream(spark, d, "symbol string, time timestamp, seq long, open double, high double, low double, close double, volume double", stream.stream_merged, tmp_path, "smerged").sort_values("time")
    assert len(got) > 20 and (got.n_merged == 2).all() and got.open.iloc[3] == 6.0 and got.close.iloc[3] == 7.0


def test_bias_battery_and_jumps(spark):
    trades = registry._trades(spark, SF)
    surface = trades.groupBy(F.floor(F.col("l_quantity") / 10).alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y")).agg(F.avg("pnl").alias("v"))
    got = checks.bias_battery(trades, registry._hourly(spark, SF), surface, ["l_returnflag"], registry.ORDER.split(", "), "l_linestatus").collect()
    assert [r.check for r in got] == ["luck", "runs", "plateau", "regimes", "coverage"] and {r.verdict for r in got} <= {"pass", "warn", "fail"}
    b = bars().assign(i=range(60), atr=1.0)
    b.loc[30:, ["open", "high", "low", "close"]] += 50
    assert [r.i for r in checks.jumps(spark.createDataFrame(b)).collect()] == [30]


def test_draws_of_a_statistic_equal_single_markets(spark):
    grouped = sessions.session_groups(registry._hourly(spark, SF))

    def last_cross(bars):
        return signals.ema_pair(bars, 3, 8).groupBy("symbol").agg(F.sum(F.col("cross").cast("long")).alias("crosses"))

    got = {(r.perm, r.symbol): r.crosses for r in families.against_draws(grouped, last_cross, 3).collect()}
    draws = inference.permuted_bars(grouped, 3)
    for perm in (0, 2):
        one = {(perm, r.symbol): r.crosses for r in last_cross(draws.filter(F.col("perm") == perm).drop("perm")).collect()}
        assert one == {k: v for k, v in got.items() if k[0] == perm}


def test_dominance_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    won, every = np.round(rng.normal(0.3, 1, 40), 1), np.round(rng.normal(0, 1, 200), 1)
    df = lambda x: spark.createDataFrame([(float(v),) for v in x], "oos_metric double")
    got = families.dominance(df(won), df(every)).first()
    grid = np.unique(np.r_[won, every])
    a, b = np.array([(won >= x).mean() for x in grid]), np.array([(every >= x).mean() for x in grid])
    area = np.trapezoid([(every <= x).mean() - (won <= x).mean() for x in grid], grid)
    assert got.dominates == bool((a >= b - 1e-12).all() and (a > b + 1e-12).any()) and math.isclose(got.area, area, abs_tol=1e-9)


def test_insample_test_counts_all_draws(spark):
    grouped = sessions.session_groups(registry._hourly(spark, SF).filter("symbol = 'click'"))

    def features(b):
        from edgelab.operators import indicators

        x = signals.ema_pair(indicators.atr(b), 3, 8)
        up, down = inference.cross_events(F.col("fast"), F.col("slow"))
        return sessions.with_sessions(x).select("symbol", "i", "open", "high", "low", "close", "atr", up.alias("long"), down.alias("short"), F.lit(True).alias("in_window"), (F.col("fast") > F.col("slow")).alias("trend_up"))

    r = families.insample_test(grouped, features, 4, 0.1, 3).first()
    assert r.symbol == "click" and r.p in {k / 5 for k in range(1, 6)}
    w = families.walk_forward_test(grouped, features, 2, 0.1, 60, 40, 1).first()
    assert w is None or 0 < w.p <= 1
