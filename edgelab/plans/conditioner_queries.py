"""Registered queries of path conditioners, direction calls, linear filters, families of cells and fading."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conditioners, indicators, inference, levels, sessions, signals
from .level_queries import ANCHORED
from .registry import BASE, CELLS, DIGITS, RETURNS, SESSIONS, _cells, _hourly, _returns, _sql, _vr_sql, query
from .signal_queries import PAIR_SQL, STEPS, recursion

#: Bars of a path, bars that a slot's baseline and a z-score need here (hourly bars have about six a slot in the first fifth).
LOOK, LEAST, Z_LEAST = 10, 3, 30

RAW = f"""{SESSIONS}, {STEPS}, {recursion('att', 'mv', {'a': ('(1.0/14)', 'x.tr')})},
c1 AS (SELECT s.*, m // 15 AS slot, s.i < floor(count(*) OVER (PARTITION BY s.symbol) * 0.2) AS calib, s.close - lag(s.close) OVER w AS r, s.close - lag(s.close, {LOOK}) OVER w AS net, lag(a) OVER w AS atr FROM s JOIN att USING (symbol, i) WINDOW w AS (PARTITION BY s.symbol ORDER BY s.i)),
c2 AS (SELECT *, sign(r) AS sg, CASE WHEN sign(r) <> lag(sign(r)) OVER w THEN 1 ELSE 0 END AS flip FROM c1 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
c3 AS (SELECT *, CASE WHEN count(r) OVER p = {LOOK} THEN sum(abs(r)) OVER p END AS path, CASE WHEN count(r) OVER p = {LOOK} THEN abs(sum(sg) OVER p) / {LOOK}.0 END AS persist, CASE WHEN count(*) OVER p = {LOOK} THEN -(sum(flip) OVER p) / {LOOK - 1}.0 END AS rot, net / ({LOOK} * 3600) AS sp, net / CASE WHEN atr > 0 THEN atr END AS disp FROM c2 WINDOW p AS (PARTITION BY symbol ORDER BY i ROWS {LOOK - 1} PRECEDING)),
b1 AS (SELECT symbol, slot, avg(sp) AS m1, stddev_samp(sp) AS s1 FROM c3 WHERE calib AND sp IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}), b2 AS (SELECT symbol, slot, avg(volume) AS m2 FROM c3 WHERE calib AND volume IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
rw AS MATERIALIZED (SELECT c3.*, CASE WHEN path > 0 THEN net / path ELSE 0 END AS ser, CASE WHEN s1 > 0 THEN (sp - m1) / s1 END AS speed, CASE WHEN m2 > 0 THEN volume / m2 END AS relvol FROM c3 LEFT JOIN b1 USING (symbol, slot) LEFT JOIN b2 USING (symbol, slot))"""


def _raw(spark, sf_dir):
    return conditioners.raw_conditioners(indicators.atr(_hourly(spark, sf_dir)), LOOK, 3600, 0.2, LEAST)


@query(_sql(f"{BASE}, {RAW}, result AS (SELECT symbol, i, disp, ser, persist, rot, speed, relvol FROM rw)", "symbol i", "disp ser persist rot speed relvol"))
def path_conditioners(spark, sf_dir):
    """Six measures of the path so far, two of them against the time of day."""
    return _raw(spark, sf_dir).select("symbol", "i", "disp", "ser", "persist", "rot", "speed", "relvol")


CONDITIONED = f"""{RAW}, {PAIR_SQL}, cd AS (SELECT rw.*, dir AS d FROM rw JOIN pk USING (symbol, i)),
z1 AS (SELECT symbol, avg(disp * d) AS zm, stddev_samp(disp * d) AS zs FROM cd WHERE calib AND disp IS NOT NULL GROUP BY 1 HAVING count(*) >= {Z_LEAST}), z2 AS (SELECT symbol, avg(relvol) AS vm, stddev_samp(relvol) AS vs FROM cd WHERE calib AND relvol IS NOT NULL GROUP BY 1 HAVING count(*) >= {Z_LEAST}),
cl AS MATERIALIZED (SELECT cd.symbol, cd.i, cd.calib, cd.d, cd.close, cd.atr, unnest([{{'cond': 'disp', 'x': disp * d}}, {{'cond': 'ser', 'x': ser * d}}, {{'cond': 'persist', 'x': persist}}, {{'cond': 'rot', 'x': rot}}, {{'cond': 'speed', 'x': speed * d}}, {{'cond': 'relvol', 'x': relvol}},
 {{'cond': 'composite', 'x': 0.3 * (disp * d - zm) / CASE WHEN zs > 0 THEN zs END + 0.25 * ser * d + 0.2 * speed * d + 0.15 * persist + 0.1 * (relvol - vm) / CASE WHEN vs > 0 THEN vs END}}], recursive := true) FROM cd LEFT JOIN z1 USING (symbol) LEFT JOIN z2 USING (symbol)),
qt AS (SELECT symbol, cond, d, quantile_cont(x, [1.0/3, 2.0/3]) AS q FROM cl WHERE calib AND x IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20),
ts AS MATERIALIZED (SELECT cl.*, CASE WHEN x >= q[2] THEN 1 WHEN x <= q[1] THEN -1 END AS side FROM cl JOIN qt USING (symbol, cond, d) WHERE x IS NOT NULL AND NOT calib AND atr > 0),
fw AS (SELECT symbol, i, lead(close, 4) OVER w - close AS f4, CASE WHEN count(*) OVER f = 4 THEN max(high) OVER f - close END AS up4, CASE WHEN count(*) OVER f = 4 THEN close - min(low) OVER f END AS dn4 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i), f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
ot AS MATERIALIZED (SELECT ts.*, f4 * d / atr AS ret, CASE WHEN d > 0 THEN up4 ELSE dn4 END / atr AS mfe, CASE WHEN d > 0 THEN dn4 ELSE up4 END / atr AS mae, (up4 + dn4) / atr AS span FROM ts JOIN fw USING (symbol, i))"""


def _conditioned(spark, sf_dir):
    bars = _hourly(spark, sf_dir)
    pair = signals.ema_pair(bars, 8, 21).select("symbol", "i", F.col("dir"))
    long = conditioners.conditioned(_raw(spark, sf_dir).join(pair, ["symbol", "i"]), F.col("dir"), Z_LEAST)
    x = levels.terciles(long.select("symbol", "i", "calib", "d", "atr", "cond", "x"), "x", ["symbol", "cond", "d"], F.col("calib"), 20).filter("not calib and atr > 0")
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(1, 4)
    whole = F.count("*").over(w) == 4
    ahead = bars.select("symbol", "i", (F.lead("close", 4).over(Window.partitionBy("symbol").orderBy("i")) - F.col("close")).alias("f"), F.when(whole, F.max("high").over(w) - F.col("close")).alias("up"), F.when(whole, F.col("close") - F.min("low").over(w)).alias("down"))
    long = F.col("d") > 0
    return x.join(ahead, ["symbol", "i"]).withColumn("ret", F.col("f") * F.col("d") / F.col("atr")).withColumn("mfe", F.when(long, F.col("up")).otherwise(F.col("down")) / F.col("atr")).withColumn("mae", F.when(long, F.col("down")).otherwise(F.col("up")) / F.col("atr")).withColumn("span", (F.col("up") + F.col("down")) / F.col("atr"))


@query(_sql(f"""{BASE}, {CONDITIONED}, g AS (SELECT cond, d, count(ret) FILTER (side = 1) AS n_long, count(ret) FILTER (side = -1) AS n_short, avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) AS dd, sqrt(coalesce(var_samp(ret) FILTER (side = 1) / nullif(count(ret) FILTER (side = 1), 0), 0) + coalesce(var_samp(ret) FILTER (side = -1) / nullif(count(ret) FILTER (side = -1), 0), 0)) AS se FROM ot WHERE side IS NOT NULL GROUP BY 1, 2),
result AS (SELECT cond, d AS state, n_long, n_short, CASE WHEN n_long >= 30 AND n_short >= 30 THEN dd END AS d, CASE WHEN n_long >= 30 AND n_short >= 30 AND se > 0 THEN dd / se END AS t FROM g)""", "cond state n_long n_short", "d t"))
def path_quality_information(spark, sf_dir):
    """Top against bottom thirds of each conditioner within an EMA state."""
    x = _conditioned(spark, sf_dir).filter("side is not null")
    return inference.welch(x.withColumn("state", F.col("d")), "ret", ["cond", "state"], 30)


@query(_sql(f"""{BASE}, {CONDITIONED}, g AS (SELECT cond, {', '.join(f"avg({c}) FILTER (side = 1) / nullif(avg({c}) FILTER (side = -1), 0) AS {c}_ratio" for c in ('mfe', 'mae', 'span'))}, count(*) FILTER (side = 1) AS n_hi, count(*) FILTER (side = -1) AS n_lo FROM ot GROUP BY 1), result AS (SELECT * FROM g)""", "cond n_hi n_lo", "mfe_ratio mae_ratio span_ratio"))
def conditioner_confound(spark, sf_dir):
    """Does a conditioner select moves, or only volatility: mean excursions of top over bottom thirds."""
    return conditioners.outcome_ratios(_conditioned(spark, sf_dir), ["cond"], ["mfe", "mae", "span"])


@query(f"""{BASE}, {ANCHORED}, {recursion('em', 'bars', {'e': ('(2.0/21)', 'x.close')})},
d1 AS (SELECT an.symbol, an.i, an.close, zone, e, e - lag(e, 5) OVER w AS sl, an.close - lag(an.close, 5) OVER w AS pr, an.close - lag(an.close, 20) OVER w AS lr FROM an JOIN em USING (symbol, i) WHERE kind = 'ny' WINDOW w AS (PARTITION BY an.symbol ORDER BY an.i)),
d2 AS (SELECT *, CASE WHEN count(pr) OVER h = 100 THEN (pr - avg(pr) OVER h) / nullif(stddev_samp(pr) OVER h, 0) END AS zz, coalesce(sign(pr), 0) AS sh, coalesce(sign(lr), 0) AS lo FROM d1 WINDOW h AS (PARTITION BY symbol ORDER BY i ROWS 99 PRECEDING)),
d3 AS (SELECT symbol, i, close, unnest([{{'call_kind': 'close_vs_ema', 'call': coalesce(sign(close - e), 0)}}, {{'call_kind': 'ema_slope', 'call': coalesce(sign(sl), 0)}}, {{'call_kind': 'vwap_zone', 'call': sign(zone)}}, {{'call_kind': 'past_return', 'call': sh}}, {{'call_kind': 'past_return_z', 'call': CASE WHEN abs(zz) >= 1 THEN sign(zz) ELSE 0 END}}, {{'call_kind': 'two_scale', 'call': CASE WHEN lo <> 0 AND sh = -lo THEN lo ELSE 0 END}}], recursive := true) FROM d2),
d4 AS (SELECT *, lead(close, 5) OVER w AS later, max(i) OVER (PARTITION BY symbol, call_kind) AS last FROM d3 WINDOW w AS (PARTITION BY symbol, call_kind ORDER BY i)), d5 AS (SELECT *, sign(later - close) AS move FROM d4 WHERE i >= 200 AND (i - 200) % 5 = 0 AND i < last + 1 - 5)
SELECT symbol, call_kind, 5 AS n, count(*) AS samples, CAST(sum(CASE WHEN call <> 0 AND move <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS called, round(avg(CASE WHEN call <> 0 AND move <> 0 THEN CASE WHEN call = move THEN 1 ELSE 0 END END), 5) AS accuracy, round(avg(CASE WHEN move > 0 THEN 1 ELSE 0 END), 5) AS base_rate FROM d5 GROUP BY 1, 2""")
def direction_screen(spark, sf_dir):
    """Six calls of the direction of the next five bars."""
    calls = conditioners.direction_calls(levels.anchored_bands(_hourly(spark, sf_dir), ("ny",)), 5)
    return signals.accuracy(calls, [5], 200, ["symbol", "call_kind"])


@query()
def direction_ceiling(spark, sf_dir):
    """Best accuracy of a linear rule on ten past returns (a test holds it against a least-squares solver)."""
    return conditioners.linear_ceiling(_hourly(spark, sf_dir), 10, 5, least=50)


@query(_sql(f"""{BASE}, {SESSIONS}, {RETURNS}, ac AS (SELECT ret.*, s.i - row_number() OVER (PARTITION BY ret.symbol ORDER BY ret.i) AS run FROM ret JOIN s USING (symbol, i) WHERE in_rth), rl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS len FROM ac) WHERE len > 2), {_vr_sql('rl', 'PARTITION BY symbol, run ORDER BY i', '2 * windows', 2).replace('result AS', 'vrr AS')},
sg AS (SELECT symbol, stddev_samp(r) AS sigma FROM rl GROUP BY 1),
result AS (SELECT symbol, n, vr - 1 AS rho, 1 / sqrt(n) AS se, -0.0001 / (4 * sigma * sigma) AS bounce, abs(vr - 1) * sigma * sqrt(2 / pi()) AS gross, abs(vr - 1) * sigma * sqrt(2 / pi()) - 0.001 AS net, CASE WHEN vr - 1 + 1.96 / sqrt(n) < 0 THEN abs(vr - 1 + 1.96 / sqrt(n)) * sigma * sqrt(2 / pi()) ELSE 0 END - 0.001 AS net_low FROM vrr JOIN sg USING (symbol))""", "symbol n", "rho se bounce gross net net_low"))
def fade_economics(spark, sf_dir):
    """Is the mean reversion of regular hours larger than bounce and cost?"""
    x = inference.runs_of(sessions.with_sessions(_returns(spark, sf_dir)), F.col("in_rth"), 2).select("symbol", "i", "r", "run")
    vr = inference.variance_ratio(x, 2, segmented=True).join(x.groupBy("symbol").agg(F.stddev_samp("r").alias("sigma")), "symbol")
    return conditioners.fade_economics(vr, 0.01, 0.001)


@query(f"""{BASE}, {CELLS}, lim AS (SELECT symbol, horizon, quantile_cont(abs(t), 0.95) AS l FROM cells WHERE perm > 0 GROUP BY 1, 2), live AS (SELECT c.symbol, c.horizon, l FROM cells c JOIN lim USING (symbol, horizon) WHERE perm = 0 AND t IS NOT NULL),
ov AS (SELECT perm, symbol, horizon, count(*) FILTER (abs(t) > l) AS over FROM cells JOIN live USING (symbol, horizon) GROUP BY GROUPING SETS ((perm), (perm, symbol), (perm, horizon))),
re AS (SELECT symbol, horizon, over AS seen FROM ov WHERE perm = 0)
SELECT coalesce(ov.symbol, 'all') AS symbol, coalesce(ov.horizon, 0) AS horizon, max(seen) AS cells_over, round((1 + count(*) FILTER (over >= seen)) / (1 + count(*)), {DIGITS}) AS p_count FROM ov JOIN re ON ov.symbol IS NOT DISTINCT FROM re.symbol AND ov.horizon IS NOT DISTINCT FROM re.horizon WHERE perm > 0 GROUP BY 1, 2""")
def family_slices(spark, sf_dir):
    """The family's count test by symbol, by horizon and whole."""
    return inference.slice_counts(_cells(spark, sf_dir), ["symbol", "horizon"])


@query(f"""{BASE}, {CELLS}, re AS (SELECT symbol, horizon, t FROM cells WHERE perm = 0 AND t IS NOT NULL), wi AS (SELECT * FROM re ORDER BY abs(t) DESC, symbol, horizon LIMIT 1),
pe AS (SELECT median(abs(re.t)) AS m FROM re, wi WHERE re.symbol = wi.symbol AND re.horizon <> wi.horizon), ot AS (SELECT count(*) AS n, bool_and(sign(re.t) = sign(wi.t)) AS same, max(abs(re.t)) AS most FROM re, wi WHERE re.horizon = wi.horizon AND re.symbol <> wi.symbol)
SELECT symbol, horizon, round(t, {DIGITS}) AS winner_t, round(m, {DIGITS}) AS peer_median, round(abs(t) / nullif(m, 0), {DIGITS}) AS peer_ratio, n AS others, coalesce(same AND most >= 1.5, false) AS others_agree FROM wi, pe, ot""")
def winner_support(spark, sf_dir):
    """Is the best cell a plateau, and do other symbols agree?"""
    return inference.winner_support(_cells(spark, sf_dir).filter("perm = 0"), "symbol", ["horizon"])


@query(f"""{BASE}, {CELLS}, top AS (SELECT symbol, horizon, t FROM cells WHERE perm = 0 AND t IS NOT NULL ORDER BY abs(t) DESC, symbol, horizon LIMIT 5) SELECT symbol, horizon, round(t, {DIGITS}) AS t FROM top""")
def top_cells(spark, sf_dir):
    """The five cells with the largest statistic (a report: the limit is its feature)."""
    return _cells(spark, sf_dir).filter("perm = 0 and t is not null").orderBy(F.desc(F.abs("t")), "symbol", "horizon").limit(5).select("symbol", "horizon", "t")
