"""Registered queries of reports over trades and bars, executions and account phases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import governance
from ..operators import account, checks, execution, funding, indicators, inference, sessions, signals, trading
from ..sources import bars as src
from .registry import BASE, LOCAL, ORDER, PNL, QUOTED, SESSIONS, TICKS, _bars_sql, _features, _hourly, _lineitem, _returns, _sql, _trades, query, rounded
from .signal_queries import PAIR_SQL, STEPS, recursion


@query(f"""WITH g AS (SELECT l_linestatus, count(*) AS n, sum({PNL}) AS total FROM lineitem GROUP BY 1), s AS (SELECT *, greatest(total, 0) / nullif(sum(greatest(total, 0)) OVER (), 0) AS share FROM g)
SELECT l_linestatus, n, round(total, 2) AS total, round(share, 5) AS share, CASE WHEN max(share) OVER () > 0.8 THEN 'warn' ELSE 'pass' END AS verdict FROM s""")
def regime_balance(spark, sf_dir):
    """Results by regime and whether one dominates."""
    return trading.regime_balance(_trades(spark, sf_dir), "l_linestatus").withColumn("total", rounded("total", 2))


@query(f"""WITH t AS (SELECT l_returnflag, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS part, {PNL} AS pnl, greatest(least({PNL} / 100, 15), -15) AS r FROM lineitem)
SELECT l_returnflag, part, count(*) AS n, round(avg(r), 5) AS mean_r, round(quantile_cont(r, 0.5), 5) AS median_r, round(sum(r) FILTER (r > 0) / nullif(-sum(r) FILTER (r < 0), 0), 5) AS profit_factor, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 5) AS win_rate, round(sum(pnl), 2) AS total FROM t GROUP BY 1, 2""")
def split_summary(spark, sf_dir):
    """Trade statistics before and after a date."""
    return trading.split_summary(_trades(spark, sf_dir), ["l_returnflag"], F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "pnl", "r").withColumn("total", rounded("total", 2))


MONTHS = [f"m{k:02d}" for k in range(1, 13)]


@query(f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {', '.join(f'round(coalesce(sum({PNL}) FILTER (month(l_shipdate) = {k}), 0), 2) AS m{k:02d}' for k in range(1, 13))}, round(sum({PNL}), 2) AS total FROM lineitem GROUP BY 1""")
def month_table(spark, sf_dir):
    """Results by year and month."""
    t = trading.month_table(_lineitem(spark, sf_dir), "l_shipdate")
    return t.select("year", *(rounded(c, 2).alias(c) for c in [*MONTHS, "total"]))


@query(f"""{BASE}, g AS (SELECT symbol, strftime(make_timestamp(ts * 1000000), '%Y-%W') AS mo, count(*) AS bars FROM bars GROUP BY 1, 2), h AS (SELECT *, max(bars) OVER (PARTITION BY symbol) AS most FROM g)
SELECT symbol, count(*) AS months, round(quantile_cont(bars, 0.5), 5) AS median_bars FROM h WHERE bars > 0.5 * most GROUP BY 1""")
def usual_period(spark, sf_dir):
    """Median bars a week (the month report on data of one month), thin weeks left out."""
    day = F.floor(F.col("ts") / 86400)
    # Weeks as strftime's %W has them: from Mondays on, days before the year's first Monday in week 0.
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7)
    return trading.usual_month(_hourly(spark, sf_dir).withColumn("mo", F.concat_ws("-", F.year(date).cast("string"), week.cast("string"))), "mo")


@query(f"""WITH t AS (SELECT l_returnflag, {PNL} AS pnl, lead({PNL}) OVER (PARTITION BY l_returnflag ORDER BY {ORDER}) AS nxt FROM lineitem)
SELECT l_returnflag, round(avg(nxt) FILTER (pnl > 0), 5) AS after_win, round(avg(nxt) FILTER (pnl < 0), 5) AS after_loss, count(*) AS pairs FROM t WHERE nxt IS NOT NULL GROUP BY 1""")
def trade_dependence(spark, sf_dir):
    """The next trade after winners and after losers."""
    return trading.dependence(_trades(spark, sf_dir), ["l_returnflag"], ORDER.split(", "))


@query(f"""WITH m AS (SELECT avg({PNL}) AS mean FROM lineitem) SELECT l_returnflag, count(*) AS n, round(sum({PNL} - mean) / count(*), 5) AS mean_left FROM lineitem, m GROUP BY 1""")
def zero_edge(spark, sf_dir):
    """Trades less their common mean, by flag."""
    return funding.zero_edge(_trades(spark, sf_dir)).groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.sum("pnl") / F.count("*")).alias("mean_left"))


@query(f"""{BASE}, {SESSIONS}, a AS (SELECT *, i - row_number() OVER (PARTITION BY symbol ORDER BY i) AS run FROM s WHERE in_rth), l AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS len FROM a)
SELECT symbol, count(*) AS bars, count(DISTINCT run) AS runs, CAST(max(len) AS BIGINT) AS longest FROM l WHERE len >= 4 GROUP BY 1""")
def conditional_runs(spark, sf_dir):
    """Bars of unbroken runs of at least four in regular hours."""
    x = inference.runs_of(sessions.with_sessions(_hourly(spark, sf_dir)), F.col("in_rth"), 3)
    return x.groupBy("symbol").agg(F.count("*").alias("bars"), F.countDistinct("run").alias("runs"), F.max("run_length").alias("longest"))


@query(f"""{BASE} SELECT symbol, name, CAST(sum(CASE WHEN ts < stamp THEN 1 ELSE 0 END) AS BIGINT) AS first_bar FROM bars, (VALUES ('validate', 1704844800), ('holdout', 1705708800)) v(name, stamp) GROUP BY 1, 2""")
def date_boundaries(spark, sf_dir):
    """Bar numbers at which dates begin."""
    return governance.boundaries(_hourly(spark, sf_dir), {"validate": 1704844800, "holdout": 1705708800})


@query(f"""WITH {QUOTED}, pq AS (SELECT *, seq % 2 AS part, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bs) OVER w AS pbs, lag(az) OVER w AS pas FROM qt WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
f AS (SELECT *, CASE WHEN type < 2 AND pb IS NOT NULL AND pa IS NOT NULL THEN CASE WHEN bid >= pb THEN bs ELSE 0 END - CASE WHEN bid <= pb THEN pbs ELSE 0 END - CASE WHEN ask <= pa THEN az ELSE 0 END + CASE WHEN ask >= pa THEN pas ELSE 0 END END AS o, CASE WHEN type <> 2 THEN 0 WHEN abs(price - ask) <= 1e-8 + 1e-5 * abs(ask) THEN 1 WHEN abs(price - bid) <= 1e-8 + 1e-5 * abs(bid) THEN -1 ELSE 0 END AS sg FROM pq),
g AS (SELECT symbol, part, (ts // 3600) * 3600 AS ts, sum(o) AS ofi, sum(sg * size) AS sv, sum(CASE WHEN type = 2 THEN size ELSE 0 END) AS v, avg(ask - bid) AS ms, count(*) AS u FROM f GROUP BY 1, 2, 3)
SELECT symbol, ts, round(sum(ofi), 5) AS ofi, round(sum(sv), 5) AS signed_volume, round(sum(v), 5) AS volume, round(avg(ms), 5) AS mean_spread, CAST(sum(u) AS BIGINT) AS updates, count(*) AS parts FROM g GROUP BY 1, 2""")
def merged_order_flow(spark, sf_dir):
    """Order-flow bars of two parts of the stream with the same stamps, merged."""
    q = checks.quotes(src.event_ticks(spark, sf_dir))
    flows = [checks.order_flow(q.filter(F.col("seq") % 2 == k)) for k in (0, 1)]
    return checks.merge_flow(flows[0].unionByName(flows[1]))


@query(f"""WITH t AS (SELECT o_custkey AS id, o_orderdate AS "when", o_totalprice AS score FROM orders) SELECT CAST(count(*) AS BIGINT) AS trials, round(sum(score), 2) AS total FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY "when" DESC, score DESC) = 1)""")
def unique_trials(spark, sf_dir):
    """The last record of each id."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("when"), F.col("o_totalprice").alias("score"))
    return governance.latest(t, ["id"], ["when", "score"]).agg(F.count("*").alias("trials"), rounded(F.sum("score"), 2).alias("total"))


@query(_sql(f"""{BASE}, {SESSIONS}, {recursion('ep', 'bars', {'f': ('(2.0/9)', 'x.close'), 's': ('(2.0/22)', 'x.close')})}, fl AS (SELECT s.symbol, s.i, session, close, CASE WHEN in_rth THEN CASE WHEN f > ep.s THEN 1 ELSE -1 END ELSE 0 END AS position FROM s JOIN ep USING (symbol, i)),
result AS (SELECT symbol, i, session, position, position * (lead(close) OVER w - close) - CASE WHEN position <> coalesce(lag(position) OVER w, 0) THEN 0.05 ELSE 0 END AS pnl FROM fl WINDOW w AS (PARTITION BY symbol ORDER BY i) QUALIFY pnl IS NOT NULL)""", "symbol i session position", "pnl"))
def follow_the_cross(spark, sf_dir):
    """Always on the cross's side in regular hours."""
    return execution.flip_on_cross(_hourly(spark, sf_dir), 8, 21, 0.1)


STOP, TARGET, AFTER, TRAIL, FILL = 40.0, 120.0, 20.0, 15.0, 0.1


@query(_sql(f"""WITH RECURSIVE {TICKS}, {_bars_sql()}, {_bars_sql(14400, 'coarse')}, {SESSIONS}, {PAIR_SQL.replace('bars', 'coarse')},
si AS (SELECT symbol, ts, d FROM (SELECT symbol, ts, CASE WHEN dir = 1 AND pd = -1 THEN 1 WHEN dir = -1 AND pd = 1 THEN -1 END AS d FROM pk) WHERE d IS NOT NULL),
c0 AS (SELECT si.*, (SELECT min(b.i) FROM bars b WHERE b.symbol = si.symbol AND b.ts >= si.ts + 14400) AS entry_i FROM si),
c1 AS (SELECT c0.*, s.session, s.close AS entry_px FROM c0 JOIN s ON s.symbol = c0.symbol AND s.i = c0.entry_i AND s.in_rth),
h0 AS (SELECT c1.symbol, c1.ts, entry_i, d, entry_px, s.i, s.open * d AS o, CASE WHEN d > 0 THEN s.high ELSE -s.low END AS hi, CASE WHEN d > 0 THEN s.low ELSE -s.high END AS lo, s.close * d AS c, entry_px * d AS e FROM c1 JOIN s ON s.symbol = c1.symbol AND s.session = c1.session AND s.in_rth AND s.i > entry_i),
h1 AS (SELECT *, greatest(e, coalesce(max(hi) OVER b, e)) AS best, least(e, coalesce(min(lo) OVER b, e)) AS worst, lead(i) OVER w IS NULL AS fin FROM h0 WINDOW w AS (PARTITION BY symbol, ts ORDER BY i), b AS (PARTITION BY symbol, ts ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h2 AS (SELECT *, best - e >= {AFTER} AS armed, greatest(e - {STOP}, CASE WHEN best - e >= {AFTER} THEN best - {TRAIL} END) AS lvl FROM h1),
h3 AS (SELECT *, CASE WHEN o <= lvl THEN o WHEN lo <= lvl THEN lvl WHEN hi >= e + {TARGET} THEN e + {TARGET} WHEN fin THEN c END AS px, CASE WHEN o <= lvl THEN CASE WHEN armed THEN 'trail' ELSE 'gap_stop' END WHEN lo <= lvl THEN CASE WHEN armed THEN 'trail' ELSE 'stop' END WHEN hi >= e + {TARGET} THEN 'target' WHEN fin THEN 'session_close' END AS reason FROM h2),
tr AS MATERIALIZED (SELECT symbol, ts, entry_i, i AS exit_i, d AS direction, entry_px, px * d AS exit_px, px - e - {FILL} AS pnl, CASE WHEN reason = 'session_close' THEN greatest(best, hi) ELSE best END - e AS mfe, e - CASE WHEN reason = 'session_close' THEN least(worst, lo) ELSE worst END AS mae, reason, row_number() OVER (PARTITION BY symbol ORDER BY entry_i, ts) AS n FROM (SELECT * FROM h3 WHERE px IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY i) = 1)),
tk AS (SELECT symbol, n, true AS take, exit_i AS busy FROM tr WHERE n = 1 UNION ALL SELECT tr.symbol, tr.n, tr.entry_i > busy, CASE WHEN tr.entry_i > busy THEN tr.exit_i ELSE busy END FROM tk JOIN tr ON tr.symbol = tk.symbol AND tr.n = tk.n + 1),
result AS (SELECT symbol, entry_i, exit_i, direction, reason, entry_px, exit_px, pnl, mfe, mae FROM tr JOIN tk USING (symbol, n) WHERE take)""", "symbol entry_i exit_i direction reason", "entry_px exit_px pnl mfe mae"))
def trailing_trades(spark, sf_dir):
    """Crosses on four-hour bars traded on hourly bars with a trailing stop."""
    coarse = signals.ema_pair(src.resample_bars(_hourly(spark, sf_dir), 14400), 8, 21)
    before = F.lag("dir").over(Window.partitionBy("symbol").orderBy("i"))
    found = coarse.withColumn("direction", F.when(F.col("dir") != before, F.col("dir"))).filter("direction is not null").select("symbol", "ts", "direction")
    t = execution.trailing_trades(found, _hourly(spark, sf_dir), 14400, STOP, TARGET, AFTER, TRAIL, FILL)
    return t.select("symbol", "entry_i", "exit_i", "direction", "reason", "entry_px", "exit_px", "pnl", "mfe", "mae")


@query()
def opening_range_retests(spark, sf_dir):
    """Breaks of the opening range, retested and reclaimed, on quarter-hour bars (a test holds it against a plain version)."""
    fine = src.event_bars(spark, sf_dir, 900)
    return execution.range_retests(fine, src.resample_bars(fine, 1800), src.resample_bars(fine, 3600), 60, range_minutes=60, least_range=1, least_before=4, near_atr=2.0)


@query()
def exit_search(spark, sf_dir):
    """The best of 45 exits for each series (a test holds the objective against a plain version)."""
    f = _features(spark, sf_dir)
    return execution.search(f, f.select("symbol", "i", "close"), 0.1, ["symbol"], 10)


@query()
def walk_forward_exits(spark, sf_dir):
    """Exits chosen on a trailing window and traded on the bars after it."""
    f = _features(spark, sf_dir)
    _, pnl = execution.walk_forward(f, f.select("symbol", "i", "close"), 0.1, 300, 100, 5)
    return pnl.groupBy("symbol", "fold").agg(F.count("*").alias("bars"), F.sum("pnl").alias("pnl"))


def _days(spark, sf_dir, dll=None):
    t = _lineitem(spark, sf_dir).select(F.to_date("l_shipdate").alias("day"), "l_orderkey", "pnl")
    t = t.select("day", F.row_number().over(Window.partitionBy("day").orderBy("l_orderkey", "pnl")).cast("long").alias("exit_order"), (F.col("pnl") / 10).alias("pnl"), F.greatest(-F.col("pnl") / 10, F.lit(0.0)).alias("mae"))
    return account.day_results(t.select("day").distinct(), t, dll)


@query(f"""WITH t AS (SELECT CAST(l_shipdate AS DATE) AS day, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, {PNL}) AS k, {PNL} / 10 AS pnl FROM lineitem), c AS (SELECT *, sum(pnl) OVER (PARTITION BY day ORDER BY k) AS after FROM t), s AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY day ORDER BY k), 0) AS start FROM c)
SELECT CAST(day AS VARCHAR) AS day, round(sum(pnl), 4) AS gain, round(min(least(start - greatest(-pnl, 0), after)), 4) AS low FROM s GROUP BY 1""")
def day_results(spark, sf_dir):
    """Result and lowest point of every day."""
    return _days(spark, sf_dir).select(F.col("day").cast("string").alias("day"), rounded("gain", 4).alias("gain"), rounded("low", 4).alias("low"))


@query()
def funded_accounts(spark, sf_dir):
    """Payouts of funded accounts over whole days drawn at random (tests hold the rules against accounts followed by hand)."""
    f = funding.simulate_funded(_days(spark, sf_dir), funding.FUNDED["TOPSTEP_XFA_50K"], 8_000)
    return f.agg(F.count("*").alias("accounts"), F.avg("receipts").alias("receipts"), F.avg("payouts").alias("payouts"), F.avg("capped").alias("capped"), F.avg(F.col("bust_day").isNotNull().cast("int")).alias("busted"))
