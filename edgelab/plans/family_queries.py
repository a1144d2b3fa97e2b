"""Registered queries of families of configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import families, indicators, inference, sessions
from .conditioner_queries import LEAST, RAW, Z_LEAST, _raw
from .registry import BASE, PERMS, RETURNS, SESSIONS, _hourly, _returns, _splits, _sql, _vr_sql, query
from .signal_queries import PAIR_SQL, STEPS, recursion

AHEAD = """fw AS (SELECT bars.*, lag(a) OVER w AS atr, lead(close, 1) OVER w - close AS v1, lead(close, 4) OVER w - close AS v4, lead(high, 1) OVER w - close AS u1, close - lead(low, 1) OVER w AS d1, CASE WHEN count(*) OVER f = 4 THEN max(high) OVER f - close END AS u4, CASE WHEN count(*) OVER f = 4 THEN close - min(low) OVER f END AS d4
 FROM bars JOIN att USING (symbol, i) WINDOW w AS (PARTITION BY bars.symbol ORDER BY bars.i), f AS (PARTITION BY bars.symbol ORDER BY bars.i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
ra AS MATERIALIZED (SELECT fw.symbol, fw.i, unnest([{'horizon': 1, 'move': v1 / atr, 'up': u1 / atr, 'down': d1 / atr}, {'horizon': 4, 'move': v4 / atr, 'up': u4 / atr, 'down': d4 / atr}], recursive := true) FROM fw JOIN s ON s.symbol = fw.symbol AND s.i = fw.i WHERE in_rth AND atr > 0)"""
ATT = f"{STEPS}, {recursion('att', 'mv', {'a': ('(1.0/14)', 'x.tr')})}"


def welch_sql(source: str, keys: str, value: str, least: int) -> str:
    return f"""g AS (SELECT {keys}, count({value}) FILTER (side = 1) AS n_long, count({value}) FILTER (side = -1) AS n_short, avg({value}) FILTER (side = 1) - avg({value}) FILTER (side = -1) AS dd, sqrt(coalesce(var_samp({value}) FILTER (side = 1) / nullif(count({value}) FILTER (side = 1), 0), 0) + coalesce(var_samp({value}) FILTER (side = -1) / nullif(count({value}) FILTER (side = -1), 0), 0)) AS se FROM {source} GROUP BY ALL),
result AS (SELECT {keys}, n_long, n_short, CASE WHEN n_long >= {least} AND n_short >= {least} THEN dd END AS d, CASE WHEN n_long >= {least} AND n_short >= {least} AND se > 0 THEN dd / se END AS t FROM g)"""


def _wma(x: str, n: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN ({' + '.join(f'coalesce(lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY i), 0) * {n - k}' for k in range(n))}) / {n * (n + 1) // 2} END"


def _pairs_sql() -> str:
    emas = sorted({*families.FAST, *families.SLOW, *families.VWAP_SLOW})
    weight = lambda n: f"({2.0 / (n + 1)!r})"
    e1 = recursion("e1", "bars", {f"ema{n}": (weight(n), "x.close") for n in emas})
    e2 = recursion("e2", "e1m", {f"b{n}": (weight(n), f"x.ema{n}") for n in families.FAST})
    e3 = recursion("e3", "e2m", {f"c{n}": (weight(n), f"x.b{n}") for n in families.FAST})
    raws = ", ".join(f"2 * {_wma('close', max(n // 2, 1))} - {_wma('close', n)} AS raw{n}" for n in families.FAST)
    hulls = ", ".join(f"{_wma(f'raw{n}', max(int(n ** 0.5), 1))} AS hma{n}" for n in families.FAST)
    pairs = ", ".join(f"{{'cfg': '{n}', 'fast': {f}, 'slow': {s}}}" for n, f, s in families.pair_family())
    return f"""{e1}, e1m AS MATERIALIZED (SELECT * FROM e1), {e2}, e2m AS MATERIALIZED (SELECT * FROM e2), {e3},
hr AS MATERIALIZED (SELECT symbol, i, {raws} FROM bars), hl AS MATERIALIZED (SELECT symbol, i, {hulls} FROM hr),
vw AS (SELECT symbol, i, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM s WINDOW w AS (PARTITION BY symbol, session ORDER BY i)),
al AS MATERIALIZED (SELECT e1m.*, vwap, {', '.join(f'hma{n}' for n in families.FAST)}, {', '.join(f'3 * (ema{n} - b{n}) + c{n} AS tema{n}' for n in families.FAST)} FROM e1m JOIN e2m USING (symbol, i) JOIN e3 USING (symbol, i) JOIN hl USING (symbol, i) JOIN vw USING (symbol, i)),
pl AS MATERIALIZED (SELECT symbol, i, unnest([{pairs}], recursive := true) FROM al),
pc AS (SELECT *, coalesce(fast > slow, false) AS above, coalesce(lag(fast > slow) OVER w, false) AS was, fast IS NOT NULL AND slow IS NOT NULL AND lag(fast) OVER w IS NOT NULL AND lag(slow) OVER w IS NOT NULL AS known FROM pl WINDOW w AS (PARTITION BY symbol, cfg ORDER BY i)),
pe AS (SELECT pc.symbol, cfg, horizon, move, CASE WHEN above THEN 1 ELSE -1 END AS side FROM pc JOIN ra USING (symbol, i) WHERE known AND above <> was)"""


@query(_sql(f"{BASE}, {SESSIONS}, {ATT}, {AHEAD}, {_pairs_sql()}, {welch_sql('pe', 'symbol, cfg, horizon', 'move', 5)}", "symbol cfg horizon n_long n_short", "d t"))
def ma_pair_information(spark, sf_dir):
    """Crosses of 61 pairs of averages: what follows, by pair and horizon."""
    return families.pair_information(indicators.atr(_hourly(spark, sf_dir)), [1, 4], 5)


def _frequency_sql(pairs, counts) -> str:
    parts, sql = [], []
    for f, s in pairs:
        sql.append(recursion(f"p{f}", "bars", {"f": (f"({2.0 / (f + 1)!r})", "x.close"), "s": (f"({2.0 / (s + 1)!r})", "x.close")}))
        sql.append(f"q{f} AS MATERIALIZED (SELECT *, CASE WHEN f > s THEN 1 ELSE -1 END AS dir, coalesce((f > s) <> (lag(f > s) OVER (PARTITION BY symbol ORDER BY i)), false) AS crs, i < floor(count(*) OVER (PARTITION BY symbol) * 0.4) AS calib FROM p{f})")
        for k in counts:
            parts.append(f"SELECT symbol, i, calib, crs, dir AS d, 'ema{f}-{s}/K{k}' AS cfg, CASE WHEN i >= {k} THEN sum(CAST(crs AS INTEGER)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS crosses FROM q{f}")
    return ", ".join(sql) + f""", fq AS MATERIALIZED (SELECT *, -CAST(crosses AS DOUBLE) AS quiet FROM ({' UNION ALL '.join(parts)}) WHERE crs AND crosses IS NOT NULL),
fp AS (SELECT symbol, cfg, quantile_cont(quiet, [1.0/3, 2.0/3]) AS q FROM fq WHERE calib GROUP BY 1, 2 HAVING count(*) >= 5),
ft AS (SELECT fq.*, CASE WHEN quiet >= q[2] THEN 1 WHEN quiet <= q[1] THEN -1 END AS side FROM fq JOIN fp USING (symbol, cfg)),
fo AS (SELECT ft.cfg, ft.side, ra.horizon, unnest([{{'outcome': 'ret', 'x': move * d}}, {{'outcome': 'mfe', 'x': CASE WHEN d > 0 THEN up ELSE down END}}, {{'outcome': 'mae', 'x': -CASE WHEN d > 0 THEN down ELSE up END}}], recursive := true) FROM ft JOIN ra USING (symbol, i) WHERE side IS NOT NULL)"""


@query(_sql(f"{BASE}, {SESSIONS}, {ATT}, {AHEAD}, {_frequency_sql(((8, 21), (10, 29)), (20, 50))}, {welch_sql('fo', 'cfg, outcome, horizon', 'x', 5)}", "cfg outcome horizon n_long n_short", "d t"))
def cross_frequency_information(spark, sf_dir):
    """Crosses after quiet and after busy stretches (windows that hourly bars of a month can fill)."""
    return families.frequency_information(indicators.atr(_hourly(spark, sf_dir)), [1, 4], 5, 5, 0.4, ((8, 21), (10, 29)), (20, 50))


FILTERED = f"""{RAW}, {PAIR_SQL}, en AS (SELECT symbol, i, entry, d FROM (SELECT symbol, i, dir, unnest([{{'entry': 'L0/ema8-21', 'st': started}}, {{'entry': 'L3/ema8-21', 'st': lag(started, 3) OVER w}}, {{'entry': 'L6/ema8-21', 'st': lag(started, 6) OVER w}}], recursive := true), dir AS d FROM pk WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE st = d),
ce AS MATERIALIZED (SELECT rw.*, entry, en.d FROM rw JOIN en USING (symbol, i)),
z1 AS (SELECT symbol, avg(disp * d) AS zm, stddev_samp(disp * d) AS zs FROM ce WHERE calib AND disp IS NOT NULL GROUP BY 1 HAVING count(*) >= 5), z2 AS (SELECT symbol, avg(relvol) AS vm, stddev_samp(relvol) AS vs FROM ce WHERE calib AND relvol IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
cl AS MATERIALIZED (SELECT ce.symbol, ce.i, ce.calib, ce.entry, ce.d, unnest([{{'cond': 'disp', 'x': disp * d}}, {{'cond': 'ser', 'x': ser * d}}, {{'cond': 'persist', 'x': persist}}, {{'cond': 'rot', 'x': rot}}, {{'cond': 'speed', 'x': speed * d}}, {{'cond': 'relvol', 'x': relvol}},
 {{'cond': 'composite', 'x': 0.3 * (disp * d - zm) / CASE WHEN zs > 0 THEN zs END + 0.25 * ser * d + 0.2 * speed * d + 0.15 * persist + 0.1 * (relvol - vm) / CASE WHEN vs > 0 THEN vs END}}], recursive := true) FROM ce LEFT JOIN z1 USING (symbol) LEFT JOIN z2 USING (symbol)),
qt AS (SELECT symbol, entry, cond, quantile_cont(x, [1.0/3, 2.0/3]) AS q FROM cl WHERE calib AND x IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3),
ts AS (SELECT cl.*, CASE WHEN x >= q[2] THEN 1 WHEN x <= q[1] THEN -1 END AS side FROM cl JOIN qt USING (symbol, entry, cond) WHERE x IS NOT NULL),
to1 AS (SELECT ts.cond, ts.entry, ts.side, ra.horizon, unnest([{{'outcome': 'ret', 'v': move * d}}, {{'outcome': 'mfe', 'v': CASE WHEN d > 0 THEN up ELSE down END}}, {{'outcome': 'mae', 'v': -CASE WHEN d > 0 THEN down ELSE up END}}], recursive := true) FROM ts JOIN ra USING (symbol, i) WHERE side IS NOT NULL)"""


@query(_sql(f"{BASE}, {FILTERED.replace(PAIR_SQL, PAIR_SQL + ', ' + AHEAD)}, {welch_sql('to1', 'cond, entry, outcome, horizon', 'v', 5)}", "cond entry outcome horizon n_long n_short", "d t"))
def cross_filter_information(spark, sf_dir):
    """Entries after crosses that hold, by thirds of each conditioner."""
    bars = indicators.atr(_hourly(spark, sf_dir))
    return families.filter_information(bars, _raw(spark, sf_dir), [1, 4], 3, 5, 5, ((8, 21),), (0, 3, 6))


@query(" UNION ALL ".join(f"SELECT * FROM ({_sql(f'{BASE}, {RETURNS}, ' + _vr_sql('ret', 'PARTITION BY symbol ORDER BY i', f'{q} * (n - {q} + 1) * (1 - {q}.0 / n)', q).replace('result AS', 'vq AS') + f', sg AS (SELECT symbol, stddev_samp(r) AS sigma FROM ret GROUP BY 1), result AS (SELECT symbol, {q} AS q, n, vr, m2, CASE WHEN vr > 0 THEN sigma * sqrt({q}) * (sqrt(vr) - 1) END AS edge FROM vq JOIN sg USING (symbol))', 'symbol q n', 'vr m2 edge')})" for q in (2, 4, 8, 16)))
def variance_profile(spark, sf_dir):
    """Variance ratios over four horizons and what they are worth."""
    return families.variance_profile(_returns(spark, sf_dir).select("symbol", "i", "r"), (2, 4, 8, 16))


@query()
def variance_survey(spark, sf_dir):
    """VR(2) inside and outside regular hours against permuted markets, one-sided (a test holds it against single markets)."""
    def measured(bars):
        x = sessions.with_sessions(bars.withColumn("r", F.ln("close") - F.ln(F.lag("close").over(families.series())))).filter("r is not null")
        return inference.variance_ratio(inference.runs_of(x, F.col("in_rth"), 2).select("symbol", "i", "r", "run"), 2, segmented=True)

    cells = families.against_draws(sessions.session_groups(_hourly(spark, sf_dir)), measured, PERMS)
    return inference.signed_pvalues(cells.select("perm", "symbol", "vr"), ["symbol"])


@query()
def split_dominance(spark, sf_dir):
    """Do in-sample winners dominate all configurations out of sample (a test holds it against a plain version)?"""
    metrics = inference.split_metrics(*_splits(spark, sf_dir, parts=True))
    return families.dominance(inference.split_winners(metrics), metrics)
