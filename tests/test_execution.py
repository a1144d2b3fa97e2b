"""Executions, exit grids, accounts and scans against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgelab.operators import account, conditioners, execution, funding, inference, kernels, levels, scan, sessions, signals, trading
from edgelab.plans import registry

SF = "/root/testdata/sf0.001"


def frame(spark, n=300, seed=5, symbol="x", start=1_704_063_600, step=3600):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(size=n).cumsum()
    open_ = np.r_[close[0], close[:-1]] + rng.normal(size=n) * 0.1
    high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
    p = pd.DataFrame({"symbol": symbol, "i": np.arange(n), "ts": start + step * np.arange(n), "open": open_, "high": high, "low": low, "close": close, "volume": rng.random(n) * 100})
    return p, spark.createDataFrame(p)


@pytest.mark.parametrize("alpha", [1.0, 0.97, 0.5, 0.01, 0.0])
def test_scan_for_any_weight(spark, alpha):
    p, df = frame(spark, 600)
    got = scan.smooth(df, F.col("close"), alpha, "y").orderBy("i").toPandas()["y"].to_numpy()
    want = [p.close[0]]
    for x in p.close[1:]:
        want.append((1 - alpha) * want[-1] + alpha * x)
    assert np.allclose(got, want, rtol=1e-12)
    assert scan.ema(df, F.col("close"), 1, "y").filter("y <> close").count() == 0


def test_scans_share_a_pass_and_keep_columns(spark):
    p, df = frame(spark, 520)
    got = scan.scan_many(df, {"a": scan.span("close", 5), "b": scan.wilder("open", 14)}).orderBy("i").toPandas()
    assert np.allclose(got.a, p.close.ewm(span=5, adjust=False).mean()) and np.allclose(got.b, p.open.ewm(alpha=1 / 14, adjust=False).mean())
    assert list(got.columns) == [*p.columns, "a", "b"] and np.allclose(got.high, p.high)


def plain_trailing(p, signals, after, stop, target, trail_after, trail, cost):
    """Trade after trade, bar after bar."""
    out, busy = [], -1
    for ts, d in signals:
        later = p[p.ts >= ts + after]
        if later.empty or later.i.iloc[0] <= busy or not later.in_rth.iloc[0]:
            continue
        a = int(later.i.iloc[0])
        entry = p.close[a]
        level, best, armed = entry - d * stop, entry, False
        session = p.session[a]
        rows = p[(p.i > a) & p.in_rth & (p.session == session)]
        if rows.empty:
            continue
        for r in rows.itertuples():
            if (r.open - level) * d <= 0:
                px, why = r.open, "trail" if armed else "gap_stop"
            elif ((r.low if d > 0 else r.high) - level) * d <= 0:
                px, why = level, "trail" if armed else "stop"
            elif ((r.high if d > 0 else r.low) - entry) * d >= target:
                px, why = entry + d * target, "target"
            elif r.i == rows.i.iloc[-1]:
                px, why = r.close, "session_close"
            else:
                best = max(best, r.high) if d > 0 else min(best, r.low)
                armed = armed or (best - entry) * d >= trail_after
                if armed:
                    level = max(level, best - trail) if d > 0 else min(level, best + trail)
                continue
            out.append((a, r.i, d, round(px, 9), why, round((px - entry) * d - cost, 9)))
            busy = r.i
            break
    return out


def test_trailing_trades(spark):
    _, df = frame(spark, 900, step=900)
    p = sessions.with_sessions(df).orderBy("i").toPandas()
    rng = np.random.default_rng(2)
    found = [(int(t), int(rng.choice([-1, 1]))) for t in sorted(rng.choice(p.ts, 120, replace=False))]
    s = spark.createDataFrame([("x", t, d) for t, d in found], "symbol string, ts long, direction int")
    args = (900, 1.5, 3.0, 1.0, 0.6, 0.1)
    got = execution.trailing_trades(s, df, *args).orderBy("entry_i").collect()
    assert [(r.entry_i, r.exit_i, r.direction, round(r.exit_px, 9), r.reason, round(r.pnl, 9)) for r in got] == plain_trailing(p, found, *args) and len(got) > 20


def plain_retest(g, side, level, target, armed):
    """One session and side, with a loop over bars."""
    touch = None
    for j, r in enumerate(g):
        if r["minutes"] < armed or r["minutes"] >= 900 or r["tol"] is None:
            continue
        if touch is None:
            if (r["close"] - r["mean"]) * side < 0 and abs((r["low"] if side > 0 else r["high"]) - level) <= r["tol"]:
                touch = j
            continue
        if (r["close"] - r["mean"]) * side <= 0:
            continue
        stop = min(x["low"] for x in g[touch : j + 1]) if side > 0 else max(x["high"] for x in g[touch : j + 1])
        if (r["close"] - stop) * side <= 0:
            touch = None
            continue
        if (target - r["close"]) * side <= 0:
            return None
        for x in g[j + 1 :]:
            if x["minutes"] >= 900:
                return r["i"], x["i"], x["open"], "session_close"
            if ((x["low"] if side > 0 else x["high"]) - stop) * side <= 0:
                return r["i"], x["i"], stop, "stop"
            if ((x["high"] if side > 0 else x["low"]) - target) * side >= 0:
                return r["i"], x["i"], target, "target"
        return r["i"], g[-1]["i"], g[-1]["close"], "session_close"
    return None


def test_range_retests(spark):
    rng = np.random.default_rng(9)
    found = 0
    for k in range(60):
        n = 40
        close = 100 + rng.normal(size=n).cumsum()
        g = [{"i": j, "minutes": 540 + 12 * j, "open": close[j] + rng.normal() * 0.2, "close": close[j], "high": close[j] + rng.random(), "low": close[j] - rng.random(), "mean": 100 + 0.5 * (close[j] - 100), "tol": 1.5 if j else None} for j in range(n)]
        side, level, armed = int(rng.choice([-1, 1])), 100.0, 560
        target = level + side * 4
        pdf = pd.DataFrame(g).assign(symbol="x", session="s", side=side, level=level, target=target, armed=armed)
        got, want = execution._retests(pdf), plain_retest(g, side, level, target, armed)
        assert (want is None) == got.empty
        if want:
            found += 1
            r = got.iloc[0]
            assert (r.entry_i, r.exit_i, r.reason) == (want[0], want[1], want[3]) and math.isclose(r.exit, want[2])
    assert found > 15


def plain_trades(p, stop_x, target_x, flip, cost):
    """The bar simulator again, as a list of events for one preset."""
    out, pos = [], None
    rows = p.to_dict("records")
    for k, r in enumerate(rows):
        end = r["in_window"] and (k == len(rows) - 1 or not rows[k + 1]["in_window"])
        ok = r["in_window"] and not end and r["atr"] == r["atr"] and r["atr"] > 0
        closed = False
        if pos:
            d, e = pos["d"], pos["e"]
            pos["mfe"] = max(pos["mfe"], (r["high"] - e) if d > 0 else (e - r["low"]))
            pos["mae"] = max(pos["mae"], (e - r["low"]) if d > 0 else (r["high"] - e))
            s, t = pos["s"], pos["t"]
            px = None
            if s is not None and (r["open"] - s) * d <= 0:
                px, why = r["open"], "stop"
            elif t is not None and (r["open"] - t) * d >= 0:
                px, why = r["open"], "tp"
            elif s is not None and ((r["low"] if d > 0 else r["high"]) - s) * d <= 0:
                px, why = s, "stop"
            elif t is not None and ((r["high"] if d > 0 else r["low"]) - t) * d >= 0:
                px, why = t, "tp"
            elif flip and (d > 0) != r["trend_up"]:
                px, why = r["close"], "flip"
            elif ok and r["short" if d > 0 else "long"]:
                out.append((pos["i"], r["i"], d, (r["close"] - e) * d - cost, "reverse"))
                pos = {"i": r["i"], "d": -d, "e": r["close"], "s": None if stop_x is None else r["close"] + d * stop_x * r["atr"], "t": None if target_x is None else r["close"] - d * target_x * r["atr"], "mfe": 0, "mae": 0}
                continue
            elif end:
                px, why = r["close"], "flat"
            if px is not None:
                out.append((pos["i"], r["i"], d, (px - e) * d - cost, why))
                pos, closed = None, True
        if pos is None and ok and not closed and (r["long"] or r["short"]):
            d = 1 if r["long"] else -1
            pos = {"i": r["i"], "d": d, "e": r["close"], "s": None if stop_x is None else r["close"] - d * stop_x * r["atr"], "t": None if target_x is None else r["close"] + d * target_x * r["atr"], "mfe": 0, "mae": 0}
    if pos:
        out.append((pos["i"], rows[-1]["i"], pos["d"], (rows[-1]["close"] - pos["e"]) * pos["d"] - cost, "end"))
    return out


def test_simulated_and_marked_trades_on_the_given_table(spark):
    f = registry._features(spark, SF).select("symbol", "i", "open", "high", "low", "close", "atr", "long", "short", "in_window", "trend_up").toPandas().sort_values(["symbol", "i"])
    got = registry.QUERIES["simulated_trades"](spark, SF).toPandas()
    marked = registry.QUERIES["marked_trades"](spark, SF).toPandas().set_index(["symbol", "cfg"])
    total = 0
    for symbol, p in f.groupby("symbol"):
        for cfg, (s, t, flip) in trading.PRESETS.items():
            want = plain_trades(p, s, t, flip, 0.1)
            mine = got[(got.symbol == symbol) & (got.cfg == cfg)].sort_values("entry_i")
            assert [(r.entry_i, r.exit_i, r.direction, r.reason) for r in mine.itertuples()] == [(a, b, d, w) for a, b, d, _, w in want]
            assert np.allclose(mine.pnl, [x for *_, x, _ in want], atol=2e-5)
            total += len(want)
            if want:
                assert math.isclose(marked.pnl[symbol, cfg], sum(x for *_, x, _ in want), abs_tol=1e-3)
    assert total > 20


def test_exit_search_objective(spark):
    f = registry._features(spark, SF)
    best = execution.search(f, f.select("symbol", "i", "close"), 0.1, ["symbol"], 3).collect()
    p = f.toPandas().sort_values(["symbol", "i"])
    assert best and len(execution.exit_grid()) == 45
    for r in best:
        one = p[p.symbol == r.symbol]
        close = one.set_index("i").close
        scores = {}
        for cfg, (s, t, flip) in execution.exit_grid().items():
            bar = {}
            trades = kernels.simulate_series(one.assign(symbol="x"), {cfg: (s, t, flip)}, 0.1)
            for a, z, d, px in zip(trades.entry_i, trades.exit_i, trades.direction, trades.exit_px):
                for i in range(a + 1, z + 1):
                    bar[i] = bar.get(i, 0) + ((px - 0.1 * d if i == z else close[i]) - close[i - 1]) * d
            gain, loss = sum(x for x in bar.values() if x > 0), -sum(x for x in bar.values() if x < 0)
            if len(trades) >= 3 and loss > 0:
                scores[cfg] = gain / loss
        assert math.isclose(r.profit_factor, max(scores.values()), rel_tol=1e-9)


def test_walk_forward_uses_only_the_past(spark):
    f = registry._features(spark, SF)
    n = f.groupBy("symbol").count().agg(F.max("count")).first()[0]
    picks, pnl = execution.walk_forward(f, f.select("symbol", "i", "close"), 0.1, n // 2, n // 4, 1)
    assert pnl.filter(F.col("i") < n // 2).count() == 0
    later = f.withColumn("close", F.when(F.col("i") >= n // 2, F.col("close") * 2).otherwise(F.col("close")))
    again, _ = execution.walk_forward(later, later.select("symbol", "i", "close"), 0.1, n // 2, n // 4, 1)
    first = lambda x: sorted(map(tuple, x.filter("fold = 0").select("symbol", "cfg").collect()))
    assert first(picks) == first(again)


def test_draw_pvalue_and_family_denominators(spark):
    rows = [("a", 0, 2.0), *(("a", k, float(k)) for k in range(1, 4)), ("b", 0, 9.0)]
    s = spark.createDataFrame(rows, "cfg string, perm int, profit_factor double")
    assert {r.cfg: r.p for r in execution.draw_pvalue(s, ["cfg"]).collect()} == {"a": 3 / 4, "b": 1.0}
    f = inference.family_pvalues(spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0), ("a", 2, 3.0), ("b", 0, 5.0), ("c", 1, 9.0)], "cfg string, perm int, t double"), ["cfg"]).first()
    assert (f.observed_max, f.live_cells, f.permutations, f.p_max) == (5.0, 2, 2, 2 / 3)


def test_permuted_bars_keep_the_start_and_share_draws(spark):
    p, df = frame(spark, 120)
    both = df.unionByName(df.withColumn("symbol", F.lit("y")))
    g = sessions.session_groups(both)
    draws = inference.permuted_bars(g, 3, start=40, shared=True).toPandas()
    for perm in (1, 2, 3):
        x = draws[(draws.perm == perm) & (draws.symbol == "x")].sort_values("i").reset_index()
        y = draws[(draws.perm == perm) & (draws.symbol == "y")].sort_values("i").reset_index()
        assert np.allclose(x.close[:41], p.close[:41]) and np.allclose(x.close, y.close) and not np.allclose(x.close, p.close)
        assert math.isclose(x.close.iloc[-1], p.close.iloc[-1], rel_tol=1e-9) and np.allclose(sorted(x.volume), sorted(p.volume))
    coarse = inference.coarser_draws(inference.permuted_bars(g, 2), 14400)
    assert coarse.filter("high < low or high < close").count() == 0


def test_linear_ceiling_against_least_squares(spark):
    p, df = frame(spark, 900)
    k, n = 4, 3
    r = np.diff(np.log(p.close), prepend=np.log(p.close[0]))
    sd = pd.Series(r).rolling(50).std().to_numpy()
    rn = np.nan_to_num(np.where(sd > 0, r / sd, 0.0))
    idx = np.arange(50, len(p) - n, n)
    x, y = np.c_[np.stack([rn[idx - j] for j in range(k)], 1), np.ones(len(idx))], np.sign(p.close.to_numpy()[idx + n] - p.close.to_numpy()[idx])
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    got = conditioners.linear_ceiling(df, k, n, scale=50, least=10).first()
    assert got.n == len(idx) and math.isclose(got.accuracy, (np.sign(x @ w) == y).mean())


def test_contiguous_area_grows_greedily(spark):
    rng = np.random.default_rng(4)
    rows = [(str(s), int(lv), float(rng.integers(1, 6))) for s in range(40) for lv in rng.choice(60, 25, replace=False)]
    got = {r.session: r for r in levels.contiguous_area(spark.createDataFrame(rows, "session string, level int, vol double"), 1.0, ("session",)).collect()}
    for s in {r[0] for r in rows}:
        own = sorted((lv, v) for k, lv, v in rows if k == s)
        v = [x for _, x in own]
        lo = hi = v.index(max(v))
        while sum(v[lo : hi + 1]) < 0.7 * sum(v):
            up, down = v[hi + 1] if hi + 1 < len(v) else -1, v[lo - 1] if lo else -1
            lo, hi = (lo, hi + 1) if up >= down else (lo - 1, hi)
        assert (got[s].val, got[s].vah) == (own[lo][0], own[hi][0])


def test_driftless_races_near_gamblers_ruin(spark):
    walk = funding.driftless_walk(spark, list("abcd"), 6000)
    banded = levels.anchored_bands(walk, ("session",))
    t = levels.race_table(levels.race_events(levels.touches(banded, (1,)), walk, 78), ["k"]).first()
    assert t.n > 150 and abs(t.pA - 0.43) < 0.12


def follow_account(days, terms, order):
    """One funded account, a day at a time."""
    eq = high = last = best = got = 0.0
    wins = traded = pays = 0
    for day, k in enumerate(order, 1):
        gain, low = days[k]
        floor = terms["lock"] if pays else min(high - terms["mll"], terms["lock"])
        if eq + (min(low, gain) if terms["realtime"] else gain) <= floor:
            return got, pays, day
        eq += gain
        high, best = max(high, eq), max(best, gain)
        wins += gain >= terms["win_day"]
        traded += gain != 0
        even = terms["cap_even"] is not None and traded >= terms["even_days"] and best <= terms["even_share"] * eq
        cap = terms["cap_even"] if even else terms["cap"]
        gross = min(eq / 2, cap)
        if (wins >= 5 or even) and eq > max(last, 0) and gross >= terms["least"]:
            got += max(gross * terms["split"] - terms["fee"], 0)
            eq, pays, wins, traded, best = eq - gross, pays + 1, 0, 0, 0.0
            last = eq
    return got, pays, None


@pytest.mark.parametrize("kind", list(funding.FUNDED))
def test_funded_accounts_followed_one_by_one(kind):
    rng = np.random.default_rng(8)
    gains = rng.normal(60, 500, 200)
    lows = np.minimum(gains, 0) - rng.random(200) * 300
    terms, sims, days = funding.FUNDED[kind], 60, 126
    got = funding.funded_accounts(gains, lows, terms, sims, 4, days)
    draw = np.random.default_rng(4)
    orders, live = np.array([draw.integers(0, 200, sims) for _ in range(days)]), 0
    for k in range(sims):
        want = follow_account(list(zip(gains, lows)), terms, orders[:, k])
        assert math.isclose(got.receipts[k], want[0]) and got.payouts[k] == want[1] and (want[2] is None) == np.isinf(got.bust_day[k])
        live += want[1] > 0
    assert live > 5


def follow_evaluation(days, contracts, rules, order):
    """One evaluation with open excursions, trade after trade."""
    eq = peak = closed = won = best = 0.0
    for day, k in enumerate(order, 1):
        gain, limit = 0.0, closed - rules["drawdown"]
        for pnl, fav, adv in days[k]:
            if not rules["hard"] and gain <= -rules["daily"]:
                break
            pnl, fav, adv = pnl * contracts, fav * contracts, adv * contracts
            if rules["open_profit"]:
                peak = max(peak, eq + fav)
                if eq - adv <= min(peak - rules["drawdown"], 0):
                    return math.inf
            elif eq - adv <= limit:
                return math.inf
            if rules["hard"] and gain - adv <= -rules["daily"]:
                return math.inf
            eq, gain = eq + pnl, gain + pnl
            if rules["open_profit"]:
                peak = max(peak, eq)
                if eq <= min(peak - rules["drawdown"], 0):
                    return math.inf
            if rules["hard"] and gain <= -rules["daily"]:
                return math.inf
        if not rules["open_profit"]:
            if eq <= limit:
                return math.inf
            closed = max(closed, eq)
        if gain > 0:
            won, best = won + gain, max(best, gain)
        if eq >= rules["target"] and won > 0 and best / won <= rules["consistency"]:
            return day
    return math.inf


@pytest.mark.parametrize("firm", ["TOPSTEP", "LUCID"])
def test_pass_days_followed_one_by_one(firm):
    rng = np.random.default_rng(3)
    days = [[(float(p), max(float(p), 0) + rng.random() * 100, max(-float(p), 0) + rng.random() * 100) for p in rng.normal(20, 220, rng.integers(0, 4))] for _ in range(80)]
    rules, sims = funding.firm_rules(3000, firm), 150
    got = funding.pass_days(days, 2, rules, sims, 6)
    draw = np.random.default_rng(6)
    orders = np.array([draw.integers(0, len(days), sims) for _ in range(130)])
    want = [follow_evaluation(days, 2, rules, orders[:, k]) for k in range(sims)]
    assert got.tolist() == want and 5 < np.isfinite(got).sum() < sims
    assert set(funding.pick_and_test(days[:40], days[40:], sims=(50, 50))) == {"contracts", "train_pass", *(f"{f}_{m}" for f in ("TOPSTEP", "LUCID") for m in ("closed", "open"))}


def test_rules_and_campaign():
    assert len(funding.RULES) == 9 and funding.RULES["TOPSTEP_COMBINE_50K_NOACT_DLL1000"]["fee_monthly"] == 85.0 and funding.RULES["LUCIDPRO_EVAL_50K_INTRADAY"]["realtime"]
    status, day = np.array([1, 2, 2, 0]), np.array([21.0, 5.0, 50.0, np.inf])
    v = funding.campaign_value(status, day, funding.RULES["TOPSTEP_COMBINE_50K"], 1000.0)
    cost = 49 * 1 + 149 + 2 * (49 * 2 + 49)
    assert math.isclose(v["pass_rate"], 1 / 3) and math.isclose(v["cost"], cost) and math.isclose(v["value"], 1000 - cost) and v["unresolved"] == 0.25
    assert math.isclose(funding.campaign_value(status, day, funding.RULES["LUCIDFLEX_EVAL_50K"], 0.0)["cost"], 105.2 * 3)


def test_fixed_consistency(spark):
    days = np.array([100.0, 2000.0]), np.array([np.inf, np.inf])
    rule = {"mll": 5000.0, "lock": 0.0, "target": 3000.0, "consistency": None, "consistency_fixed": 1650.0, "realtime": False}
    status, _ = account.accounts(*days, rule, 200, 1, 400)
    assert (status == 1).sum() == 0  # a day of 2,000 is soon drawn, and then the cap is broken for good


def test_pools(spark):
    pool = funding.bracket_pool(spark, 50, 4, 100.0, 50.0, 0.4, mean=3.0)
    g = pool.agg(F.avg("pnl").alias("m"), F.count("*").alias("n")).first()
    assert g.n == 200 and math.isclose(g.m, 3.0, abs_tol=1e-9) and pool.filter("mae < 0 or mfe < 0").count() == 0


def test_regime_and_signal_edge_cases(spark):
    p, df = frame(spark, 30)
    assert signals.regime(df).filter("i < 2 and regime <> 2").count() == 0
    assert signals.wilder_adx(df).filter("i < 13 and adx is not null").count() == 0
