"""Registered queries of whole strategies, checks of order, and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, figures
from ..operators.windows import finite
from ..sources import bars as src
from . import ladder
from .registry import BASE, PERMUTED, PNL, TICKS, _hourly, _lineitem, _permuted, _trades, query, rounded
from .report_queries import _days


@query()
def strategy_summary(spark, sf_dir):
    """The base strategy's presets before and after the split (its parts have queries and SQL of their own)."""
    stats, _ = ladder.run(_hourly(spark, sf_dir), ladder.cross_strategy(8, 21), 0.1, 5.0)
    return stats


@query()
def account_campaigns(spark, sf_dir):
    """Pass rates and campaign values under nine published rule sets."""
    return spark.createDataFrame(ladder.evaluations(lambda limit: _days(spark, sf_dir, limit), sims=4_000, receipts=1_000.0), "rule string, pass_rate double, attempts double, cost double, value double, value_single double, unresolved double")


@query(f"""WITH {TICKS}, x AS (SELECT symbol, ts, seq, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM ticks)
SELECT symbol, count(*) AS n, CAST(count(*) - count(DISTINCT ts) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN ts < before THEN 1 ELSE 0 END) AS BIGINT) AS backwards FROM x GROUP BY 1""")
def order_checks(spark, sf_dir):
    """Equal stamps, and stamps that go backwards in the order of the file."""
    return checks.order_checks(src.event_ticks(spark, sf_dir))


@query(f"""WITH t AS (SELECT l_returnflag, {PNL} AS v FROM lineitem), e AS (SELECT l_returnflag, min(v) AS a, (max(v) - min(v)) / 20 AS st FROM t GROUP BY 1), b AS (SELECT t.l_returnflag, a, st, CAST(least(floor((v - a) / st), 19) AS INTEGER) AS bin FROM t JOIN e USING (l_returnflag))
SELECT l_returnflag, bin, round(a + bin * st, 4) AS low, round(a + (bin + 1) * st, 4) AS high, count(*) AS n FROM b GROUP BY l_returnflag, bin, a, st""")
def pnl_histogram(spark, sf_dir):
    """Results of trades in twenty bins."""
    h = figures.histogram(_lineitem(spark, sf_dir), ["l_returnflag"], "pnl", 20)
    return h.withColumn("low", rounded("low", 4)).withColumn("high", rounded("high", 4))


@query(f"""{BASE}, {PERMUTED}, c AS (SELECT perm, i, symbol, ln(close) AS v FROM permuted)
SELECT symbol, i, round(max(v) FILTER (perm = 0), 4) AS "real", round(quantile_cont(v, 0.05) FILTER (perm > 0), 4) AS p05, round(quantile_cont(v, 0.5) FILTER (perm > 0), 4) AS p50, round(quantile_cont(v, 0.95) FILTER (perm > 0), 4) AS p95 FROM c GROUP BY 1, 2""")
def price_fan(spark, sf_dir):
    """The market's path among the percentiles of its draws."""
    paths = _permuted(spark, sf_dir).withColumn("v", F.ln(finite("close")))
    f = figures.fan(paths, ["symbol"], "i", "v", (0.05, 0.5, 0.95))
    return f.select("symbol", "i", *(rounded(c, 4).alias(c) for c in ("real", "p05", "p50", "p95")))


@query(f"""WITH d AS (SELECT l_returnflag, l_shipdate, sum({PNL}) AS pnl FROM lineitem GROUP BY 1, 2), e AS (SELECT *, sum(pnl) OVER w AS eq FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate)), u AS (SELECT *, eq - max(eq) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS dd FROM e),
f AS (SELECT *, CASE WHEN dd < 0 AND coalesce(lag(dd) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate), 0) >= 0 THEN 1 ELSE 0 END AS fresh FROM u), s AS (SELECT *, sum(fresh) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS spell FROM f)
SELECT l_returnflag, CAST(spell AS BIGINT) AS spell, round(min(dd), 5) AS depth, count(*) AS points FROM s WHERE dd < 0 GROUP BY 1, 2""")
def underwater_spells(spark, sf_dir):
    """Spells below the last peak, with their depth and length."""
    from ..operators import trading

    d = _trades(spark, sf_dir).groupBy("l_returnflag", "l_shipdate").agg(F.sum("pnl").alias("pnl"))
    u = figures.underwater(trading.equity(d, ["l_returnflag"], ["l_shipdate"]), ["l_returnflag"], "l_shipdate")
    return u.select("l_returnflag", "spell", rounded("depth", 5).alias("depth"), "points")


@query(f"SELECT l_suppkey % 9 AS cfg, count(*) AS n, round(avg({PNL}) / nullif(stddev_samp({PNL}), 0), 6) AS sharpe FROM lineitem GROUP BY 1", digits=6)
def sharpe_ratios(spark, sf_dir):
    """Sharpe ratio of each configuration."""
    return figures.sharpe(_lineitem(spark, sf_dir).withColumn("cfg", F.col("l_suppkey") % 9), ["cfg"])
