"""A strategy from bars to verdict: features, presets, train and test statistics, account phase; and the traded ladder.

A strategy is a function from bars (symbol, i, ts, prices, volume) to features (symbol, i, prices, atr, long, short, in_window,
trend_up); anything that makes those columns plugs in, also for draws, as each draw is a series of its own name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..governance import Protocol, TrialRegister
from ..operators import account, execution, families, funding, indicators, inference, sessions, signals, trading

Strategy = Callable[[DataFrame], DataFrame]
#: Test trades from which the account phase is run (fixed value).
LEAST_TEST_TRADES = 20


def base_strategy(bars: DataFrame) -> DataFrame:
    """The base entries within their regimes, with SuperTrend's side."""
    x = indicators.atr(signals.base_entries(bars))
    x = x.join(signals.regime(bars).select("symbol", "i", "regime"), ["symbol", "i"]).join(indicators.super_trend(bars).select("symbol", "i", "super_trend"), ["symbol", "i"])
    x = sessions.with_sessions(x)
    return x.select("symbol", "i", "ts", "session", "open", "high", "low", "close", "atr", (F.col("long") & (F.col("regime") == 1)).alias("long"), (F.col("short") & (F.col("regime") == -1)).alias("short"), F.col("in_rth").alias("in_window"), (F.col("close") > F.col("super_trend")).alias("trend_up"))


def cross_strategy(fast: int, slow: int) -> Strategy:
    """Crosses of two EMAs in regular hours; the trend's side is the cross's."""

    def build(bars: DataFrame) -> DataFrame:
        x = signals.ema_pair(indicators.atr(bars), fast, slow)
        up, down = inference.cross_events(F.col("fast"), F.col("slow"))
        x = sessions.with_sessions(x.withColumn("long", up).withColumn("short", down))
        return x.select("symbol", "i", "ts", "session", "open", "high", "low", "close", "atr", "long", "short", F.col("in_rth").alias("in_window"), (F.col("fast") > F.col("slow")).alias("trend_up"))

    return build


def run(bars: DataFrame, strategy: Strategy, cost: float, point_value: float, train_share: float = 0.6, presets: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(statistics by symbol, preset and part, day results of the test trades in money): the whole of a strategy's evaluation."""
    features = strategy(bars)
    split = features.groupBy("symbol").agg(F.floor(F.count("*") * train_share).alias("split"))
    trades = trading.simulate(features, presets, cost).join(split, "symbol")
    stats = trading.split_summary(trades, ["symbol", "cfg"], F.col("entry_i") < F.col("split"))
    days = features.join(split, "symbol").filter("i >= split").select("symbol", "session", "i")
    # Trades of a day in order of exit; a stretch of several symbols shares the calendar.
    test = trades.filter("entry_i >= split").join(days.select("symbol", F.col("i").alias("exit_i"), "session"), ["symbol", "exit_i"])
    ordered = test.select("symbol", "cfg", F.col("session").alias("day"), F.row_number().over(Window.partitionBy("symbol", "cfg", "session").orderBy("exit_i", "entry_i")).cast("long").alias("exit_order"), (F.col("pnl") * point_value).alias("pnl"), (F.col("mae") * point_value).alias("mae"))
    return stats, ordered


def account_phase(stats: DataFrame, day_trades: DataFrame, calendar: DataFrame, rule: dict, symbol: str, cfg: str, sims: int = 8_000) -> DataFrame | None:
    """Evaluation results of one preset's test days, days without trades included; None with too few test trades. calendar: day of every test session."""
    n = stats.filter((F.col("symbol") == symbol) & (F.col("cfg") == cfg) & (F.col("part") == "test")).select("n").first()
    if n is None or n[0] < LEAST_TEST_TRADES:
        return None
    own = day_trades.filter((F.col("symbol") == symbol) & (F.col("cfg") == cfg))
    days = account.day_results(calendar.select("day").distinct(), own.select("day", "exit_order", "pnl", "mae"), rule.get("dll"))
    return account.simulate_accounts(days, rule, sims)


def grid_with_register(features: DataFrame, bars: DataFrame, cost: float, register: TrialRegister, name: str, when: str, least: int = 20) -> DataFrame:
    """Every exit of the grid simulated over all bars and recorded as a trial with its results by bar; returns the best of each symbol."""
    trades = trading.simulate(features, execution.exit_grid(), cost)
    marked = trading.bar_pnl(trades, bars, cost).persist()  # read once for each trial recorded
    for cfg, (stop, target, flip) in execution.exit_grid().items():
        rows = marked.filter(F.col("cfg") == cfg).groupBy(F.col("i").alias("t")).agg(F.sum("pnl").alias("pnl"))
        register.record(name, {"exit": cfg, "stop": stop, "target": target, "flip": flip}, "train", when, rows)
    return execution.best_exit(execution.grid_scores(trades, marked, ["symbol"]), ["symbol"], least)


def ladder(grouped: DataFrame, strategy: Strategy, name: str, cost: float, perms: int, lookback: int, step: int, least: int = 20, log: Callable[[str], None] = lambda text: None) -> Protocol:
    """The traded ladder of one symbol's bars (with groups): enough trades, the exit search against draws, walk-forward results,
    walk-forward against draws, costs. Rungs run when they are reached."""
    bars = grouped.select("symbol", "i", "ts", "open", "high", "low", "close", "volume")

    def told(check):
        def run_check():
            state, detail = check()
            log(f"{state}: {detail}")
            return state, detail

        return run_check

    def enough():
        n = trading.simulate(strategy(bars), execution.exit_grid(), cost).groupBy("cfg").count().agg(F.max("count")).first()[0] or 0
        return ("pass" if n >= least else "fail"), f"{n} trades of the busiest exit, {least} needed"

    def against(test):
        def check():
            r = test()
            if r is None or r["profit_factor"] is None:
                return "fail", "no exit has enough trades"
            return ("pass" if r["p"] < 0.05 else "fail"), f"profit factor {r['profit_factor']:.3f}, p {r['p']:.4f} of {perms} draws"

        return check

    def forward():
        _, pnl = execution.walk_forward(strategy(bars), bars.select("symbol", "i", "close"), cost, lookback, step, least)
        total = pnl.agg(F.sum("pnl")).first()[0]
        return ("pass" if total is not None and total > 0 else "fail"), f"walk-forward result {total}"

    def costs():
        best = execution.search(strategy(bars), bars.select("symbol", "i", "close"), 2 * cost, ["symbol"], least).first()
        good = best is not None and best["profit_factor"] > 1
        return ("pass" if good else "warn"), f"profit factor at twice the cost {best['profit_factor'] if best else None}"

    rungs = [
        ("trades", enough), ("in-sample against draws", against(lambda: families.insample_test(grouped, strategy, perms, cost, least).first())), ("walk-forward", forward),
        ("walk-forward against draws", against(lambda: families.walk_forward_test(grouped, strategy, perms, cost, lookback, step, least).first())), ("costs", costs),
    ]
    return Protocol(name, [(n, told(c)) for n, c in rungs])


def evaluations(days_of: Callable[[float | None], DataFrame], rules: dict | None = None, sims: int = 8_000, receipts: float = 0.0) -> list[dict]:
    """Pass rate and campaign value under each published rule set over one pool of days. days_of: the day results under a daily
    loss limit (None for none); two numbers a day are collected for each limit."""
    import numpy as np

    pools: dict = {}
    out = []
    for name, rule in (rules or funding.RULES).items():
        limit = rule["dll"]
        if limit not in pools:
            rows = days_of(limit).orderBy("day").select("gain", "low").collect()
            pools[limit] = np.array([r["gain"] for r in rows], float), np.array([np.inf if r["low"] is None else r["low"] for r in rows], float)
        status, ended = account.accounts(*pools[limit], rule, sims, 7)
        out.append({"rule": name, **funding.campaign_value(status, ended, rule, receipts)})
    return out
