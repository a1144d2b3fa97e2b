"""Registered queries of indicator menus, signals, line families, crosses, regimes and entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators, inference, scan, signals
from ..operators.windows import lead, series
from .registry import BASE, _hourly, _sql, query

STEPS = """st AS (SELECT *, coalesce(close - lag(close) OVER w, 0.0) AS step, coalesce(high - lag(high) OVER w, 0.0) AS ur, coalesce(lag(low) OVER w - low, 0.0) AS dr,
 greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)),
mv AS (SELECT *, CASE WHEN ur > dr AND ur > 0 THEN ur ELSE 0.0 END AS um, CASE WHEN dr > ur AND dr > 0 THEN dr ELSE 0.0 END AS dm FROM st)"""


def recursion(name: str, source: str, columns: dict[str, tuple[str, str]], keys: str = "symbol") -> str:
    """Recurrences {column: (weight, input)} that start at their input."""
    k = keys.split()
    on = " AND ".join(f"x.{c} = {name}.{c}" for c in k)
    first = ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, (_, v) in columns.items())
    after = ", ".join(f"(1 - {a}) * {name}.{c} + {a} * {v}" for c, (a, v) in columns.items())
    ks, xs = ", ".join(k), ", ".join(f"x.{c}" for c in k)
    return f"{name} AS (SELECT {ks}, i, {first} FROM {source} x WHERE i = 0 UNION ALL SELECT {xs}, x.i, {after} FROM {name} JOIN {source} x ON {on} AND x.i = {name}.i + 1)"


def wilder_sql(name: str, source: str, columns: dict[str, str], n: int) -> str:
    """Wilder's smoothing of n rows, seeded with the mean of the known ones."""
    seed = ", ".join(f"CAST(avg({v}) AS DOUBLE) AS {c}" for c, v in columns.items())
    after = ", ".join(f"({name}.{c} * {n - 1} + x.{v}) / {n}" for c, v in columns.items())
    return f"{name} AS (SELECT symbol, CAST({n - 1} AS BIGINT) AS i, {seed} FROM {source} WHERE i < {n} GROUP BY symbol UNION ALL SELECT x.symbol, x.i, {after} FROM {name} JOIN {source} x ON x.symbol = {name}.symbol AND x.i = {name}.i + 1)"


MENU_SQL = f"""{STEPS},
mw AS MATERIALIZED (SELECT *, sum(abs(step)) OVER w10 AS path, abs(close - lag(close, 10) OVER w) AS chg, CASE WHEN i >= 13 THEN coalesce(abs(sum(step) OVER w14 / nullif(sum(abs(step)) OVER w14, 0)), 0) ELSE 0 END * (2.0/21) AS vk,
 CASE WHEN i >= 13 THEN coalesce(100 * sum(step) OVER w14 / nullif(sum(abs(step)) OVER w14, 0), 0) ELSE 0 END AS cmo, CASE WHEN i >= 19 THEN (max(high) OVER w20 + min(low) OVER w20) / 2 END AS dmid, CASE WHEN i >= 19 THEN avg(close) OVER w20 END AS bm, CASE WHEN i >= 19 THEN stddev_samp(close) OVER w20 END AS bs, lag(close, 10) OVER w AS c10 FROM mv
 WINDOW w AS (PARTITION BY symbol ORDER BY i), w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)),
mx AS MATERIALIZED (SELECT *, CASE WHEN i = 9 AND path > 0 THEN 0 WHEN i < 10 OR path <= 0 THEN power(2.0/31, 2) ELSE power(chg / path * (2.0/3 - 2.0/31) + 2.0/31, 2) END AS sc FROM mw),
{recursion('r1', 'mx', {'kama': ('x.sc', 'x.close'), 'vidya': ('x.vk', 'x.close'), 'g': ('(1.0/14)', 'greatest(x.step, 0.0)'), 'l': ('(1.0/14)', 'greatest(-x.step, 0.0)'), 'up': ('(1.0/14)', 'x.um'), 'dn': ('(1.0/14)', 'x.dm'), 'atr': ('(1.0/14)', 'x.tr'), 'm1': ('(1.0/25)', 'x.step'), 'a1': ('(1.0/25)', 'abs(x.step)'), 'e20': ('(2.0/21)', 'x.close'), 'k20': ('(1.0/20)', 'x.tr'), 'fa': ('(2.0/13)', 'x.close'), 'sl': ('(2.0/27)', 'x.close')})},
q1 AS MATERIALIZED (SELECT r1.*, fa - sl AS macd FROM r1),
{recursion('r2', 'q1', {'m2': ('(1.0/13)', 'x.m1'), 'a2': ('(1.0/13)', 'x.a1'), 'sg': ('0.2', 'x.macd')})},
me AS MATERIALIZED (SELECT symbol, i, atr, unnest([{{'ind': 'kama', 'value': close, 'ref': kama}}, {{'ind': 'vidya', 'value': close, 'ref': vidya}}, {{'ind': 'rsi', 'value': CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END, 'ref': 50}}, {{'ind': 'cmo', 'value': cmo, 'ref': 0}},
 {{'ind': 'di', 'value': CASE WHEN atr > 0 THEN 100 * up / atr ELSE 0 END, 'ref': CASE WHEN atr > 0 THEN 100 * dn / atr ELSE 0 END}}, {{'ind': 'tsi', 'value': CASE WHEN a2 > 0 THEN 100 * m2 / a2 ELSE 0 END, 'ref': 0}}, {{'ind': 'donchian_mid', 'value': close, 'ref': dmid}}, {{'ind': 'bollinger_mid', 'value': close, 'ref': bm}}, {{'ind': 'keltner_mid', 'value': close, 'ref': e20}},
 {{'ind': 'bollinger_pctb', 'value': close - (bm - 2 * bs), 'ref': bm + 2 * bs - close}}, {{'ind': 'keltner_pos', 'value': close - (e20 - 2 * k20), 'ref': e20 + 2 * k20 - close}}, {{'ind': 'ema', 'value': close, 'ref': e20}}, {{'ind': 'macd', 'value': q1.macd, 'ref': sg}}, {{'ind': 'roc', 'value': CASE WHEN c10 > 0 THEN 100 * (close - c10) / c10 ELSE 0 END, 'ref': 0}}], recursive := true) FROM mx JOIN q1 USING (symbol, i) JOIN r2 USING (symbol, i))"""


@query(_sql(f"{BASE}, {MENU_SQL}, result AS (SELECT symbol, i, ind, value, ref FROM me)", "symbol i ind", "value ref"))
def indicator_menu(spark, sf_dir):
    """Fourteen indicators with their references, in long form."""
    return signals.menu(_hourly(spark, sf_dir)).select("symbol", "i", "ind", "value", "ref")


@query(f"""{BASE}, {MENU_SQL},
m2s AS MATERIALIZED (SELECT *, lag(value) OVER (PARTITION BY symbol, ind ORDER BY i) AS pv FROM me),
fr AS (SELECT symbol, ind, i, CASE WHEN value IS NULL THEN 0.0 ELSE CAST(value AS DOUBLE) END AS f FROM m2s WHERE i = 0 UNION ALL SELECT x.symbol, x.ind, x.i, CASE WHEN x.value IS NULL THEN 0.0 WHEN x.pv IS NULL THEN x.value ELSE fr.f * 2 / 3 + x.value / 3 END FROM fr JOIN m2s x ON x.symbol = fr.symbol AND x.ind = fr.ind AND x.i = fr.i + 1),
d AS (SELECT m2s.*, value - ref AS d, lag(value - ref) OVER w AS p, ref - lag(ref, 5) OVER w AS rise, coalesce(sign(value - ref), 0) AS pos, CASE WHEN value IS NOT NULL THEN f END AS f FROM m2s JOIN fr USING (symbol, ind, i) WINDOW w AS (PARTITION BY symbol, ind ORDER BY i)),
b AS (SELECT *, CASE WHEN atr > 0 THEN d / atr ELSE 0 END AS buf, count(*) OVER h AS n, min(pos) OVER h AS lo, max(pos) OVER h AS hi FROM d WINDOW h AS (PARTITION BY symbol, ind ORDER BY i ROWS 2 PRECEDING))
SELECT symbol, ind, i, CAST(pos AS INTEGER) AS position, CASE WHEN d > 0 AND p <= 0 THEN 1 WHEN d < 0 AND p >= 0 THEN -1 ELSE 0 END AS fresh, CASE WHEN buf >= 0.25 AND p <= 0 THEN 1 WHEN buf <= -0.25 AND p >= 0 THEN -1 ELSE 0 END AS buffered,
 CASE WHEN d > 0 AND rise > 0 THEN 1 WHEN d < 0 AND rise < 0 THEN -1 ELSE 0 END AS slope, CASE WHEN n = 3 AND lo = 1 THEN 1 WHEN n = 3 AND hi = -1 THEN -1 ELSE 0 END AS sustained, CAST(coalesce(sign(f - ref), 0) AS INTEGER) AS aligned FROM b""")
def indicator_signals(spark, sf_dir):
    """Six signal definitions of each indicator."""
    return signals.signals(signals.menu(_hourly(spark, sf_dir)))


ADX_SQL = f"""{STEPS}, {wilder_sql('w1', 'mv', {'a': 'tr', 'b': 'um', 'c': 'dm'}, 14)},
dx AS MATERIALIZED (SELECT mv.symbol, mv.i, 100 * b / nullif(a, 0) AS pdi, 100 * c / nullif(a, 0) AS mdi, 100 * abs(b - c) / nullif(b + c, 0) AS dx FROM mv LEFT JOIN w1 USING (symbol, i)), {wilder_sql('w2', 'dx', {'adx': 'dx'}, 14)},
ad AS MATERIALIZED (SELECT dx.*, adx FROM dx LEFT JOIN w2 USING (symbol, i))"""


@query(_sql(f"{BASE}, {ADX_SQL}, result AS (SELECT symbol, i, pdi, mdi, adx FROM ad)", "symbol i", "pdi mdi adx"))
def directional_movement(spark, sf_dir):
    """ADX and directional indices by Wilder's smoothing."""
    return signals.wilder_adx(_hourly(spark, sf_dir)).select("symbol", "i", "pdi", "mdi", "adx")


REGIME_SQL = f"""{ADX_SQL}, rg0 AS (SELECT mv.*, pdi, mdi, adx, CASE WHEN i >= 10 THEN coalesce(abs(close - lag(close, 10) OVER w) / nullif(sum(abs(step)) OVER w10, 0), 0) END AS er, CASE WHEN i >= 10 THEN coalesce((close - lag(close, 10) OVER w) / nullif(sum(abs(step)) OVER w10, 0), 0) END AS ser,
 CASE WHEN i >= 13 AND max(high) OVER w14 > min(low) OVER w14 THEN 100 * log10(sum(tr) OVER w14 / (max(high) OVER w14 - min(low) OVER w14)) / log10(14) END AS chop FROM mv JOIN ad USING (symbol, i)
 WINDOW w AS (PARTITION BY symbol ORDER BY i), w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)),
rg1 AS (SELECT *, coalesce(er > 0.35 AND adx > 30 AND pdi > mdi AND chop < 45, false) AS u, coalesce(er > 0.35 AND adx > 30 AND mdi > pdi AND chop < 45, false) AS d, coalesce(abs(ser) < 0.2, false) OR coalesce(chop > 55, false) OR coalesce(adx < 23, false) AS c FROM rg0),
rg AS (SELECT *, CASE WHEN i < 2 THEN 2 WHEN bool_and(u) OVER h THEN 1 WHEN bool_and(d) OVER h THEN -1 WHEN bool_and(c) OVER h THEN 0 ELSE 2 END AS regime FROM rg1 WINDOW h AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING))"""


@query(_sql(f"{BASE}, {REGIME_SQL}, result AS (SELECT symbol, i, regime, er, ser, chop FROM rg)", "symbol i regime", "er ser chop"))
def regimes(spark, sf_dir):
    """Trend up, trend down, chop or neither, with persistence."""
    return signals.regime(_hourly(spark, sf_dir)).select("symbol", "i", "regime", "er", "ser", "chop")


@query(f"""{BASE}, {recursion('r1', 'bars', {'e1': ('(2.0/15)', 'x.close'), 'em': ('(2.0/21)', 'x.close')})}, r1m AS MATERIALIZED (SELECT * FROM r1), {recursion('r2', 'r1m', {'e2': ('(2.0/15)', 'x.e1')})}, r2m AS MATERIALIZED (SELECT * FROM r2), {recursion('r3', 'r2m', {'e3': ('(2.0/15)', 'x.e2')})},
f AS (SELECT bars.*, em, 3 * (e1 - e2) + e3 AS te, CASE WHEN i >= 8 THEN (max(high) OVER w9 + min(low) OVER w9) / 2 END AS m9, CASE WHEN i >= 51 THEN (max(high) OVER w52 + min(low) OVER w52) / 2 END AS m52, CASE WHEN i >= 11 THEN sum(close * volume) OVER w12 / nullif(sum(volume) OVER w12, 0) END AS vw
 FROM bars JOIN r1m USING (symbol, i) JOIN r2m USING (symbol, i) JOIN r3 USING (symbol, i) WINDOW w9 AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY i ROWS 11 PRECEDING), w52 AS (PARTITION BY symbol ORDER BY i ROWS 51 PRECEDING)),
g AS (SELECT *, lag(m52, 26) OVER (PARTITION BY symbol ORDER BY i) AS line FROM f)
SELECT symbol, i, coalesce(close > m9 AND close > line, false) AS long, coalesce(te < em AND em < vw AND close < line, false) AS short FROM g""")
def base_entries(spark, sf_dir):
    """Entry conditions of the base strategy."""
    return signals.base_entries(_hourly(spark, sf_dir)).select("symbol", "i", "long", "short")


def _line_sql() -> str:
    mids = ", ".join(f"CASE WHEN i >= {n - 1} THEN (max(high) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING) + min(low) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING)) / 2 END AS mid{n}" for n in signals.MID_LENGTHS)
    lines = [(f"mid({n})", f"mid{n}") for n in signals.MID_LENGTHS] + [(f"middisp({n},{d})", f"lag(mid{n}, {d}) OVER w") for n, d in signals.DISPLACED] + [(f"span({t},{k},{d})", f"lag((mid{t} + mid{k}) / 2, {d}) OVER w") for t, k, d in signals.SPANS]
    lines += [(f"chikou({n})", f"lag(close, {n}) OVER w") for n in signals.LAGGING] + [(f"ema({n})", f"ema{n}") for n in signals.EMA_LINES]
    wide = ", ".join(f'{v} AS "{k}"' for k, v in lines)
    names = ", ".join(f'"{k}"' for k, _ in lines)
    emas = recursion("em", "bars", {f"ema{n}": (f"({2.0 / (n + 1)!r})", "x.close") for n in signals.EMA_LINES})
    return f"""{emas}, mi AS (SELECT bars.*, {', '.join(f'ema{n}' for n in signals.EMA_LINES)}, {mids} FROM bars JOIN em USING (symbol, i)),
wi AS MATERIALIZED (SELECT symbol, i, close, {', '.join(f'lead(close, {h}) OVER w AS c{h}' for h in (1, 4))}, {wide} FROM mi WINDOW w AS (PARTITION BY symbol ORDER BY i)),
li AS (SELECT * FROM wi UNPIVOT INCLUDE NULLS (line FOR cfg IN ({names})))"""


@query(_sql(f"""{BASE}, {_line_sql()}, cr AS (SELECT *, coalesce(close > line, false) AS above, coalesce(lag(close > line) OVER w, false) AS was, line IS NOT NULL AND lag(line) OVER w IS NOT NULL AS known FROM li WINDOW w AS (PARTITION BY symbol, cfg ORDER BY i)),
ev AS (SELECT *, CASE WHEN above THEN 1 ELSE -1 END AS side FROM cr WHERE known AND above <> was),
ex AS (SELECT symbol, cfg, side, 1 AS horizon, c1 - close AS ret FROM ev UNION ALL SELECT symbol, cfg, side, 4, c4 - close FROM ev),
g AS (SELECT symbol, cfg, horizon, count(ret) FILTER (side = 1) AS n_long, count(ret) FILTER (side = -1) AS n_short, avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) AS dd, sqrt(coalesce(var_samp(ret) FILTER (side = 1) / nullif(count(ret) FILTER (side = 1), 0), 0) + coalesce(var_samp(ret) FILTER (side = -1) / nullif(count(ret) FILTER (side = -1), 0), 0)) AS se FROM ex GROUP BY 1, 2, 3),
result AS (SELECT symbol, cfg, horizon, n_long, n_short, CASE WHEN n_long >= 5 AND n_short >= 5 THEN dd END AS d, CASE WHEN n_long >= 5 AND n_short >= 5 AND se > 0 THEN dd / se END AS t FROM g)""", "symbol cfg horizon n_long n_short", "d t"))
def ichimoku_information(spark, sf_dir):
    """Crosses of forty lines: what follows, by line and horizon."""
    x = signals.line_crosses(signals.cloud_lines(_hourly(spark, sf_dir)))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "cfg").orderBy("i")
    x = x.withColumn("o", F.array(*(F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(w) - F.col("close")).alias("ret")) for h in (1, 4)))).filter("side is not null")
    return inference.welch(x.select("symbol", "cfg", "side", F.explode("o").alias("o")).select("symbol", "cfg", "side", "o.*"), "ret", ["symbol", "cfg", "horizon"], 5)


PAIR_SQL = f"""{recursion('ep', 'bars', {'f': ('(2.0/9)', 'x.close'), 's': ('(2.0/22)', 'x.close')})},
pr AS (SELECT bars.*, f, s, CASE WHEN f > s THEN 1 ELSE -1 END AS dir FROM bars JOIN ep USING (symbol, i)),
pc AS MATERIALIZED (SELECT *, coalesce(dir <> lag(dir) OVER w, false) AS cross_, lag(dir) OVER w AS pd, f - s AS df, lag(f - s) OVER w AS pdf FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY i)),
pk AS MATERIALIZED (SELECT *, CASE WHEN dir = 1 AND coalesce(pd, -1) = -1 THEN 1 WHEN dir = -1 AND pd = 1 THEN -1 END AS started FROM pc)"""


@query(f"""{BASE}, {PAIR_SQL} SELECT symbol, i, dir, cross_ AS cross_here, CASE WHEN df > 0 AND pdf <= 0 THEN 1 WHEN df < 0 AND pdf >= 0 THEN -1 ELSE 0 END AS strict_side, CASE WHEN i >= 20 THEN CAST(sum(CAST(cross_ AS BIGINT)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS BIGINT) ELSE -1 END AS crosses_before,
 CASE WHEN started = dir THEN dir ELSE 0 END AS entry0, CASE WHEN lag(started, 3) OVER (PARTITION BY symbol ORDER BY i) = dir THEN dir ELSE 0 END AS entry3 FROM pk""")
def cross_filters(spark, sf_dir):
    """EMA crosses: state, strict crosses, crosses before, entries at once and three bars later."""
    x = signals.ema_pair(_hourly(spark, sf_dir), 8, 21)
    return x.select("symbol", "i", "dir", F.col("cross").alias("cross_here"), F.coalesce(signals.strict_crosses(F.col("fast"), F.col("slow")), F.lit(0)).alias("strict_side"), F.coalesce(signals.cross_count(20), F.lit(-1)).alias("crosses_before"), *(F.coalesce(signals.confirmed(k), F.lit(0)).alias(f"entry{k}") for k in (0, 3)))


@query(_sql(f"""{BASE}, {STEPS}, {recursion('att', 'mv', {'a': ('(1.0/14)', 'x.tr')})}, {PAIR_SQL},
sp AS (SELECT pk.*, lag(a) OVER (PARTITION BY symbol ORDER BY i) AS atr, sum(CASE WHEN started IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) AS grp FROM pk JOIN att USING (symbol, i)),
sq AS (SELECT *, abs(f - s) / CASE WHEN atr > 0 THEN atr END AS sep, i - min(i) OVER (PARTITION BY symbol, grp) AS age FROM sp),
result AS (SELECT symbol, i, CASE WHEN i = min(CASE WHEN grp > 0 AND age <= 12 AND sep >= 0.5 THEN i END) OVER (PARTITION BY symbol, grp) THEN dir ELSE 0 END AS entry, sep FROM sq)""", "symbol i entry", "sep"))
def separated_entries(spark, sf_dir):
    """Crosses that wait until the lines are apart."""
    x = signals.ema_pair(indicators.atr(_hourly(spark, sf_dir)), 8, 21)
    return signals.separated(x, 0.5).select("symbol", "i", F.coalesce("entry", F.lit(0)).alias("entry"), "sep")


@query(f"""{BASE}, {MENU_SQL}, cl AS (SELECT me.symbol, me.ind, me.i, coalesce(sign(value - ref), 0) AS call, b.close FROM me JOIN bars b USING (symbol, i)),
hx AS (SELECT cl.*, n, CASE n WHEN 5 THEN lead(close, 5) OVER w ELSE lead(close, 10) OVER w END AS later, max(i) OVER (PARTITION BY symbol, ind) AS last FROM cl, (VALUES (5), (10)) v(n) WINDOW w AS (PARTITION BY symbol, ind, n ORDER BY i)),
mo AS (SELECT *, sign(later - close) AS move FROM hx WHERE i >= 200 AND (i - 200) % n = 0 AND i < last + 1 - n)
SELECT symbol, ind, n, count(*) AS samples, CAST(sum(CASE WHEN call <> 0 AND move <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS called, round(avg(CASE WHEN call <> 0 AND move <> 0 THEN CASE WHEN call = move THEN 1 ELSE 0 END END), 5) AS accuracy, round(avg(CASE WHEN move > 0 THEN 1 ELSE 0 END), 5) AS base_rate FROM mo GROUP BY 1, 2, 3""")
def directional_accuracy(spark, sf_dir):
    """How often each indicator's side is the direction of the next bars."""
    bars = _hourly(spark, sf_dir)
    x = signals.menu(bars).select("symbol", "ind", "i", F.coalesce(F.signum(F.col("value") - F.col("ref")), F.lit(0.0)).alias("call")).join(bars.select("symbol", "i", "close"), ["symbol", "i"])
    return signals.accuracy(x, [5, 10], 200, ["symbol", "ind"])
