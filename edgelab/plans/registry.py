"""The registered queries over the given tables, and the same in SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import account, checks, indicators, inference, scan, sessions, trading
from ..operators.windows import col, finite, lag, log, series
from ..shipping import ship
from ..sources import bars as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "event_information"
DIGITS = 5

TICKS = """ticks AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, value AS price,
 CAST(coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS BIGINT), 0) AS DOUBLE) AS size, CAST(user_id % 3 AS INTEGER) AS type FROM events)"""


def _bars_sql(seconds: int = 3600, name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, bar AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i FROM (
 SELECT symbol, (ts // {seconds}) * {seconds} AS bar, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2))"""


LOCAL = "timezone('America/Chicago', timezone('UTC', make_timestamp(ts * 1000000)))"
SESSIONS = f"""s AS (SELECT *, m >= 510 AND m < 900 AS in_rth FROM (SELECT *, CAST(hour({LOCAL}) * 60 + minute({LOCAL}) AS BIGINT) AS m, strftime({LOCAL} + INTERVAL 7 HOURS, '%Y-%m-%d') AS session FROM bars))"""
BASE = f"WITH RECURSIVE {TICKS}, {_bars_sql()}"


def rounded(x: Column | str, digits: int) -> Column:
    """Rounds as the SQL's engine does: scaled in double precision, halves away from zero. Spark's round goes by the shortest
    decimal instead, and so takes 87 / (320 / 3), which is 0.8156249999999999, to 0.81562 and not to 0.81563."""
    x, scale = col(x), float(10**digits)
    y = F.round(x * scale) / scale
    return F.when(F.abs(y) < float("inf"), y).otherwise(x)


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sql(body: str, exact: str, doubles: str) -> str:
    """A query whose last part is `body`; columns taken as they are and rounded ones."""
    names = [x for x in exact.split() if x], [x for x in doubles.split() if x]
    return f"{body}\nSELECT {', '.join([*names[0], *(f'round({d}, {DIGITS}) AS {d}' for d in names[1])])} FROM result"


def query(sql: str | None = None, digits: int = DIGITS):
    """Registers a query, whose doubles are rounded to `digits`: as many as its SQL gives at most."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return _rounded(f(spark, sf_dir), digits)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _hourly(spark, sf_dir):
    return src.event_bars(spark, sf_dir)


CROSS = """l AS (SELECT *, CASE WHEN count(*) OVER w9 = 9 THEN (max(high) OVER w9 + min(low) OVER w9) / 2 END AS line, lead(close, 3) OVER w - close AS ret FROM bars
 WINDOW w AS (PARTITION BY symbol ORDER BY i), w9 AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING)),
c AS (SELECT *, coalesce(close > line, false) AS above, lag(line) OVER (PARTITION BY symbol ORDER BY i) AS before FROM l),
e AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY symbol ORDER BY i), false) AS was, line IS NOT NULL AND before IS NOT NULL AND lag(close) OVER (PARTITION BY symbol ORDER BY i) IS NOT NULL AS known FROM c),
ev AS (SELECT *, CASE WHEN known AND above AND NOT was THEN 1 WHEN known AND NOT above AND was THEN -1 END AS side FROM e)"""


@query(_sql(f"{BASE}, result AS (SELECT * FROM bars)", "symbol ts i", "open high low close volume"))
def hourly_bars(spark, sf_dir):
    """OHLCV bars from ticks."""
    return _hourly(spark, sf_dir).select("symbol", "ts", "i", "open", "high", "low", "close", "volume")


@query(_sql(f"WITH {TICKS}, {_bars_sql(3600)}, {_bars_sql(14400, 'result')}", "symbol ts i", "open high low close volume"))
def coarser_bars(spark, sf_dir):
    """Four-hour bars from hourly ones."""
    return src.resample_bars(_hourly(spark, sf_dir), 14400).select("symbol", "ts", "i", "open", "high", "low", "close", "volume")


@query(_sql(f"WITH {TICKS}, result AS (SELECT symbol, (ts // 86400) * 86400 AS ts, first(price ORDER BY seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY seq) AS close, sum(size) AS volume, count(*) AS n_merged FROM ticks GROUP BY 1, 2)", "symbol ts n_merged", "open high low close volume"))
def merged_duplicates(spark, sf_dir):
    """Bars with equal stamps become one, in file order."""
    t = src.event_ticks(spark, sf_dir).select("symbol", (F.floor(F.col("ts") / 86400) * 86400).alias("ts"), "seq", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.col("size").alias("volume"))
    return src.merge_duplicate_bars(t)


WINDOWS_SQL = f"""{BASE},
a AS (SELECT *, coalesce(close - lag(close) OVER w, 0.0) AS step, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
 CASE WHEN i >= 8 THEN ({' + '.join(f'coalesce(lag(close, {k}) OVER w, 0) * {9 - k}' for k in range(9))}) / 45 END AS wma9,
 CASE WHEN i >= 3 THEN ({' + '.join(f'coalesce(lag(close, {k}) OVER w, 0) * {4 - k}' for k in range(4))}) / 10 END AS wma4,
 CASE WHEN i >= 8 THEN (max(high) OVER w9 + min(low) OVER w9) / 2 END AS mid9 FROM bars
 WINDOW w AS (PARTITION BY symbol ORDER BY i), w9 AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING)),
b AS (SELECT *, 2 * wma4 - wma9 AS raw FROM a),
result AS (SELECT symbol, i, tr, wma9, CASE WHEN i >= 10 THEN (raw * 3 + lag(raw) OVER w * 2 + lag(raw, 2) OVER w) / 6 END AS hma9, mid9, lag(mid9, 26) OVER w AS mid9_displaced,
 CASE WHEN i >= 19 THEN max(high) OVER w20 END AS donchian_high, CASE WHEN i >= 19 THEN min(low) OVER w20 END AS donchian_low,
 CASE WHEN i >= 11 THEN sum(close * volume) OVER w12 / nullif(sum(volume) OVER w12, 0) END AS vwma12,
 CASE WHEN i >= 10 THEN coalesce(abs(close - lag(close, 10) OVER w) / nullif(sum(abs(step)) OVER w10, 0), 0) END AS er10,
 CASE WHEN i >= 10 THEN coalesce((close - lag(close, 10) OVER w) / nullif(sum(abs(step)) OVER w10, 0), 0) END AS ser10,
 CASE WHEN i >= 13 AND max(high) OVER w14 > min(low) OVER w14 THEN 100 * log10(sum(tr) OVER w14 / (max(high) OVER w14 - min(low) OVER w14)) / log10(14) END AS chop14,
 CASE WHEN i >= 8 THEN 100 * sum(step) OVER w9 / nullif(sum(abs(step)) OVER w9, 0) END AS cmo9,
 100 * (close - lag(close, 10) OVER w) / nullif(lag(close, 10) OVER w, 0) AS roc10,
 CASE WHEN i >= 19 THEN avg(close) OVER w20 END AS boll_mid, CASE WHEN i >= 19 THEN avg(close) OVER w20 + 2 * stddev_samp(close) OVER w20 END AS boll_high, CASE WHEN i >= 19 THEN avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20 END AS boll_low,
 min(CASE WHEN close > open THEN 1 ELSE 0 END) OVER w3 = 1 AS three_up FROM b
 WINDOW w AS (PARTITION BY symbol ORDER BY i), w3 AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING), w9 AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY i ROWS 11 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))"""
WINDOW_COLUMNS = "tr wma9 hma9 mid9 mid9_displaced donchian_high donchian_low vwma12 er10 ser10 chop14 cmo9 roc10 boll_mid boll_high boll_low"


@query(_sql(WINDOWS_SQL, "symbol i three_up", WINDOW_COLUMNS))
def window_indicators(spark, sf_dir):
    """Moving averages, channels, efficiency, choppiness, momentum: all with finite frames."""
    return indicators.window_menu(_hourly(spark, sf_dir)).select("symbol", "i", "three_up", *WINDOW_COLUMNS.split())


def _step(old: str, alpha: str, new: str) -> str:
    return f"(1 - {alpha}) * {old} + {alpha} * {new}"


_E = {"ema9": ("0.2", "x.close"), "rma_tr": ("(1.0/14)", "x.tr"), "gain": ("(1.0/14)", "greatest(x.step, 0.0)"), "loss": ("(1.0/14)", "greatest(-x.step, 0.0)"), "fast": ("(2.0/13)", "x.close"), "slow": ("(2.0/27)", "x.close"), "kama10": ("x.sc", "x.close"), "vidya12": ("x.vk", "x.close"), "m1": ("(1.0/25)", "x.step"), "a1": ("(1.0/25)", "abs(x.step)")}
_N = {k: _step(f"r.{k}", a, x) for k, (a, x) in _E.items()}
_N["e2"] = _step("r.e2", "0.2", f"({_N['ema9']})")
_N["e3"] = _step("r.e3", "0.2", f"({_N['e2']})")
_N["macd_signal"] = _step("r.macd_signal", "0.2", f"(({_N['fast']}) - ({_N['slow']}))")
_N["m2"] = _step("r.m2", "(1.0/13)", f"({_N['m1']})")
_N["a2"] = _step("r.a2", "(1.0/13)", f"({_N['a1']})")
_FIRST = {"ema9": "close", "rma_tr": "tr", "gain": "greatest(step, 0.0)", "loss": "greatest(-step, 0.0)", "fast": "close", "slow": "close", "kama10": "close", "vidya12": "close", "m1": "step", "a1": "abs(step)", "e2": "close", "e3": "close", "macd_signal": "0.0", "m2": "step", "a2": "abs(step)"}
SCAN_COLUMNS = "ema9 tema9 atr14 rsi14 macd macd_signal kama10 vidya12 tsi keltner_high keltner_low"
_INPUTS = f"""{BASE},
a AS (SELECT *, coalesce(close - lag(close) OVER w, 0.0) AS step, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)),
x AS MATERIALIZED (SELECT *, power(coalesce(CASE WHEN i >= 10 THEN abs(close - lag(close, 10) OVER w) / nullif(sum(abs(step)) OVER w10, 0) END, 0) * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc,
 coalesce(abs(CASE WHEN i >= 8 THEN 100 * sum(step) OVER w9 / nullif(sum(abs(step)) OVER w9, 0) END) / 100, 0) * (2.0/13) AS vk FROM a
 WINDOW w AS (PARTITION BY symbol ORDER BY i), w9 AS (PARTITION BY symbol ORDER BY i ROWS 8 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING))"""


@query(_sql(f"""{_INPUTS},
r AS (SELECT symbol, i, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _FIRST.items())} FROM x WHERE i = 0
 UNION ALL SELECT x.symbol, x.i, {', '.join(_N[k] for k in _FIRST)} FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1),
result AS (SELECT symbol, i, ema9, 3 * (ema9 - e2) + e3 AS tema9, rma_tr AS atr14, CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi14, fast - slow AS macd, macd_signal, kama10, vidya12, 100 * m2 / nullif(a2, 0) AS tsi, slow + 2 * rma_tr AS keltner_high, slow - 2 * rma_tr AS keltner_low FROM r)""", "symbol i", SCAN_COLUMNS))
def scan_indicators(spark, sf_dir):
    """Recurrences: EMA, TEMA, ATR, RSI, MACD, KAMA, VIDYA, TSI, Keltner."""
    return indicators.scan_menu(_hourly(spark, sf_dir)).select("symbol", "i", *SCAN_COLUMNS.split())


@query(_sql(f"""{_INPUTS}, r AS (SELECT symbol, i, close AS ema21 FROM x WHERE i = 0 UNION ALL SELECT x.symbol, x.i, r.ema21 + (x.close - r.ema21) / 11 FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1), result AS (SELECT * FROM r)""", "symbol i", "ema21"))
def affine_scan(spark, sf_dir):
    """An EMA as a scan over blocks, for series of any length."""
    return scan.ema(_hourly(spark, sf_dir), F.col("close"), 21, "ema21").select("symbol", "i", "ema21")


@query(_sql(f"""{_INPUTS},
r0 AS (SELECT symbol, i, tr AS atr FROM x WHERE i = 0 UNION ALL SELECT x.symbol, x.i, 0.9 * r0.atr + 0.1 * x.tr FROM r0 JOIN x ON x.symbol = r0.symbol AND x.i = r0.i + 1),
y AS MATERIALIZED (SELECT x.symbol, x.i, x.close, lag(x.close) OVER (PARTITION BY x.symbol ORDER BY x.i) AS c0, (high + low) / 2 - 3 * atr AS lo, (high + low) / 2 + 3 * atr AS hi FROM x JOIN r0 USING (symbol, i)),
r AS (SELECT symbol, i, lo AS line, true AS up FROM y WHERE i = 0
 UNION ALL SELECT symbol, i, CASE WHEN side AND close < now THEN hi WHEN NOT side AND close > now THEN lo ELSE now END, CASE WHEN side AND close < now THEN false WHEN NOT side AND close > now THEN true ELSE side END FROM (
  SELECT y.symbol, y.i, y.close, y.lo, y.hi, y.c0 > r.line AS side, CASE WHEN y.c0 > r.line THEN (CASE WHEN r.up THEN greatest(y.lo, r.line) ELSE y.lo END) ELSE (CASE WHEN r.up THEN y.hi ELSE least(y.hi, r.line) END) END AS now FROM r JOIN y ON y.symbol = r.symbol AND y.i = r.i + 1)),
result AS (SELECT symbol, i, line AS super_trend, up AS super_trend_up FROM r)""", "symbol i super_trend_up", "super_trend"))
def super_trend(spark, sf_dir):
    """A trend line as a state machine per series."""
    return indicators.super_trend(_hourly(spark, sf_dir)).select("symbol", "i", "super_trend_up", "super_trend")


def _crosses(spark, sf_dir):
    b = _hourly(spark, sf_dir).withColumn("line", indicators.mid_donchian(9))
    up, down = inference.cross_events(F.col("close"), F.col("line"))
    return b.withColumn("ret", F.lead("close", 3).over(series()) - F.col("close")).withColumn("side", F.when(up, 1).when(down, -1))


@query(_sql(f"{BASE}, {CROSS}, result AS (SELECT symbol, i, CAST(side AS INTEGER) AS side, ret FROM ev WHERE side IS NOT NULL)", "symbol i side", "ret"))
def cross_events(spark, sf_dir):
    """Closes crossing a channel's middle, with the move over the next three bars."""
    return _crosses(spark, sf_dir).filter("side is not null").select("symbol", "i", F.col("side").cast("int").alias("side"), "ret")


@query(_sql(f"""{BASE}, {CROSS}, g AS (SELECT symbol, count(ret) FILTER (side = 1) AS n_long, count(ret) FILTER (side = -1) AS n_short, avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) AS dd,
 sqrt(coalesce(var_samp(ret) FILTER (side = 1) / nullif(count(ret) FILTER (side = 1), 0), 0) + coalesce(var_samp(ret) FILTER (side = -1) / nullif(count(ret) FILTER (side = -1), 0), 0)) AS se FROM ev WHERE side IS NOT NULL GROUP BY symbol),
result AS (SELECT symbol, n_long, n_short, CASE WHEN n_long >= 5 AND n_short >= 5 THEN dd END AS d, CASE WHEN n_long >= 5 AND n_short >= 5 AND se > 0 THEN dd / se END AS t FROM g)""", "symbol n_long n_short", "d t"))
def event_information(spark, sf_dir):
    """Does the cross carry information: Welch's t of what follows, by symbol."""
    return inference.welch(_crosses(spark, sf_dir).filter("side is not null"), "ret", ["symbol"], 5)


@query(_sql(f"""{BASE}, f AS (SELECT symbol, i, h AS horizon, CASE h WHEN 3 THEN lead(close, 3) OVER w WHEN 6 THEN lead(close, 6) OVER w END - close AS ret, CASE h WHEN 3 THEN CASE WHEN count(*) OVER f3 = 3 THEN max(high) OVER f3 END ELSE CASE WHEN count(*) OVER f6 = 6 THEN max(high) OVER f6 END END - close AS mfe,
 close - CASE h WHEN 3 THEN CASE WHEN count(*) OVER f3 = 3 THEN min(low) OVER f3 END ELSE CASE WHEN count(*) OVER f6 = 6 THEN min(low) OVER f6 END END AS mae, high - low AS unit FROM bars, (VALUES (3), (6)) v(h)
 WINDOW w AS (PARTITION BY symbol, h ORDER BY i), f3 AS (PARTITION BY symbol, h ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), f6 AS (PARTITION BY symbol, h ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
result AS (SELECT symbol, i, horizon, CASE WHEN unit > 0 THEN ret / unit END AS ret, CASE WHEN unit > 0 THEN mfe / unit END AS mfe, CASE WHEN unit > 0 THEN mae / unit END AS mae FROM f)""", "symbol i horizon", "ret mfe mae"))
def forward_outcomes(spark, sf_dir):
    """Return and excursions over several horizons, in units of the bar's range."""
    return inference.forward_outcomes(_hourly(spark, sf_dir).withColumn("unit", F.col("high") - F.col("low")), [3, 6], "unit").select("symbol", "i", "horizon", "ret", "mfe", "mae")


@query(_sql(f"""{BASE}, {SESSIONS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM s),
v AS (SELECT *, sum(tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, sum(tp * tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS sq FROM t WINDOW w AS (PARTITION BY symbol, session ORDER BY i)),
result AS (SELECT symbol, i, session, m AS minutes, in_rth, vwap, sqrt(greatest(sq - vwap * vwap, 0)) AS vwap_sd FROM v)""", "symbol i session minutes in_rth", "vwap").replace("FROM result", ", round(vwap_sd, 3) AS vwap_sd FROM result"))
def session_vwap(spark, sf_dir):
    """Local sessions and their VWAP."""
    return sessions.session_vwap(_hourly(spark, sf_dir)).select("symbol", "i", "session", "minutes", "in_rth", "vwap", rounded("vwap_sd", 3).alias("vwap_sd"))


BANDS = f"""{SESSIONS}, t AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER (PARTITION BY symbol, session ORDER BY i) - 1 AS age FROM s),
t2 AS (SELECT *, first_value(tp) OVER (PARTITION BY symbol, session ORDER BY i) AS anchor FROM t),
v AS (SELECT *, sum((tp - anchor) * volume) OVER w / nullif(sum(volume) OVER w, 0) AS m1, sum((tp - anchor) * (tp - anchor) * volume) OVER w / nullif(sum(volume) OVER w, 0) AS m2 FROM t2 WINDOW w AS (PARTITION BY symbol, session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bands AS (SELECT *, CASE WHEN age >= 5 AND m2 - m1 * m1 > 1e-9 THEN anchor + m1 END AS mu, CASE WHEN age >= 5 AND m2 - m1 * m1 > 1e-9 THEN sqrt(m2 - m1 * m1) END AS sigma FROM v)"""


@query(_sql(f"{BASE}, {BANDS}, result AS (SELECT symbol, i, age, mu, sigma, CAST(trunc(coalesce((close - mu) / sigma, 0)) AS INTEGER) AS zone FROM bands)", "symbol i age zone", "mu sigma"))
def causal_bands(spark, sf_dir):
    """Anchored bands from the bars before, and the zone of the close."""
    return sessions.causal_bands(_hourly(spark, sf_dir)).select("symbol", "i", "age", "zone", "mu", "sigma")


RACE = """ev0 AS (SELECT * FROM bands WHERE high >= mu + sigma QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY i) = 1),
ev AS (SELECT symbol, i AS ev, mu AS tgt, mu + 2 * sigma AS ext, mu - sigma AS opp FROM ev0 JOIN (SELECT symbol, max(i) AS last FROM bars GROUP BY 1) USING (symbol) WHERE i + 8 <= last),
h AS (SELECT ev.*, b.i, b.low <= tgt AS ht, b.high >= ext AS hx, b.low <= opp AS ho FROM ev JOIN bars b ON b.symbol = ev.symbol AND b.i BETWEEN ev + 1 AND ev + 8),
f AS (SELECT symbol, ev, min(i) FILTER (ht) AS t, min(i) FILTER (hx) AS x, min(i) FILTER (ho) AS o FROM h GROUP BY 1, 2),
f2 AS (SELECT f.symbol, f.ev, min(i) FILTER (hx AND i > t) AS x2, min(i) FILTER (ho AND i > t) AS o2 FROM f JOIN h USING (symbol, ev) GROUP BY 1, 2),
j AS (SELECT symbol, t IS NOT NULL AND t < coalesce(x, 1e18) AS aw, x IS NOT NULL AND x <= coalesce(t, 1e18) AS al, t IS NOT NULL AND t = coalesce(x, -1) AS tie, o2 IS NOT NULL AND o2 < coalesce(x2, 1e18) AS bw, x2 IS NOT NULL AND x2 <= coalesce(o2, 1e18) AS bl, o IS NOT NULL AND o < coalesce(x, 1e18) AS cw, x IS NOT NULL AND x <= coalesce(o, 1e18) AS cl FROM f JOIN f2 USING (symbol, ev)),
g AS (SELECT symbol, count(*) AS n, count(*) FILTER (aw) AS a, count(*) FILTER (aw OR al) AS nA, count(*) FILTER (aw AND bw) AS b, count(*) FILTER (aw AND (bw OR bl)) AS nB, count(*) FILTER (cw) AS c, count(*) FILTER (cw OR cl) AS nC, count(*) FILTER (tie) AS ties FROM j GROUP BY 1),
result AS (SELECT symbol, n, nA, nB, nC, a / nullif(nA, 0) AS pA, b / nullif(nB, 0) AS pB, c / nullif(nC, 0) AS pC, 1 - nA / n AS unresolved, ties / n AS ambiguous FROM g)"""


@query(_sql(f"{BASE}, {BANDS}, {RACE}", "symbol n nA nB nC", "pA pB pC unresolved ambiguous"))
def band_race(spark, sf_dir):
    """After the first touch of the upper band in a session: the mean, the mirror band or one band further out first?"""
    b = sessions.causal_bands(_hourly(spark, sf_dir))
    return sessions.race(b, sessions.first_touches(b, 1, 1), 1, 1, 8)


@query(_sql(f"""{BASE}, {SESSIONS}, result AS (SELECT symbol, i, CASE WHEN in_rth AND m >= 630 THEN max(CASE WHEN in_rth AND m < 630 THEN high END) OVER w END AS or_high, CASE WHEN in_rth AND m >= 630 THEN min(CASE WHEN in_rth AND m < 630 THEN low END) OVER w END AS or_low FROM s WINDOW w AS (PARTITION BY symbol, session))""", "symbol i", "or_high or_low"))
def opening_range(spark, sf_dir):
    """The first two hours' range, known after them."""
    return sessions.opening_range(_hourly(spark, sf_dir)).select("symbol", "i", "or_high", "or_low")


@query(_sql(f"""{BASE}, p AS (SELECT *, CASE WHEN count(*) OVER a = 11 AND max(high) OVER a = high THEN high END AS ph, CASE WHEN count(*) OVER a = 11 AND min(low) OVER a = low THEN low END AS pl FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
q AS (SELECT *, lag(ph, 5) OVER w AS lh, lag(pl, 5) OVER w AS ll FROM p WINDOW w AS (PARTITION BY symbol ORDER BY i)),
result AS (SELECT symbol, i, last_value(lh IGNORE NULLS) OVER w AS swing_high, last_value(ll IGNORE NULLS) OVER w AS swing_low FROM q WINDOW w AS (PARTITION BY symbol ORDER BY i))""", "symbol i", "swing_high swing_low"))
def swing_levels(spark, sf_dir):
    """Confirmed pivots, carried on."""
    return sessions.swing_levels(_hourly(spark, sf_dir)).select("symbol", "i", "swing_high", "swing_low")


@query(_sql(f"""WITH {TICKS}, p AS (SELECT symbol, ts // 86400 AS day, CAST(round_even(price / 5, 0) AS BIGINT) AS level, sum(size) AS vol FROM ticks WHERE type = 2 GROUP BY 1, 2, 3),
q AS (SELECT *, sum(vol) OVER (PARTITION BY symbol, day) AS total, coalesce(sum(vol) OVER (PARTITION BY symbol, day ORDER BY vol DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
result AS (SELECT symbol, day, arg_max(level, {{'v': vol, 'l': -level}}) * 5.0 AS poc, max(level) FILTER (before < 0.7 * total) * 5.0 AS vah, min(level) FILTER (before < 0.7 * total) * 5.0 AS val, max(total) AS total_volume, count(*) AS levels FROM q GROUP BY 1, 2)""", "symbol day levels", "poc vah val total_volume"))
def volume_profiles(spark, sf_dir):
    """Daily volume at price: point of control and value area."""
    return sessions.profile_summary(sessions.volume_profile(src.event_ticks(spark, sf_dir), 5.0), 5.0)


GROUPS = f"""{SESSIONS}, gr AS (SELECT *, CAST(2 * sum(CASE WHEN session IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) + CAST(in_rth AS INTEGER) AS BIGINT) AS grp FROM (SELECT *, lag(session) OVER (PARTITION BY symbol ORDER BY i) AS prev FROM s))"""
#: Draws of the permutation queries; the reference runs 200 to 1,000, most of its families 300.
PERMS = 300
PERMUTED = f"""{GROUPS}, lb AS (SELECT symbol, grp, i, ts, volume, ln(open) AS lo, ln(high) AS lh, ln(low) AS ll, ln(close) AS lc FROM gr),
pa AS (SELECT *, lo - lag(lc) OVER (PARTITION BY symbol ORDER BY i) AS gap, lh - lo AS rh, ll - lo AS rl, lc - lo AS rc, first_value(lc) OVER (PARTITION BY symbol ORDER BY i) AS c0 FROM lb),
sp AS (SELECT pa.*, p.perm FROM pa, (SELECT unnest(range(1, {PERMS + 1})) AS perm) p WHERE i > 0),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY perm, symbol, grp ORDER BY i) AS slot, row_number() OVER (PARTITION BY perm, symbol, grp ORDER BY md5(concat_ws(':', 1, 1, perm, symbol, i)), i) AS r1, row_number() OVER (PARTITION BY perm, symbol, grp ORDER BY md5(concat_ws(':', 1, 2, perm, symbol, i)), i) AS r2 FROM sp),
dr AS MATERIALIZED (SELECT a.perm, a.symbol, a.i, a.ts, a.c0, b.rh, b.rl, b.rc, b.volume, c.gap FROM rk a JOIN rk b ON a.perm = b.perm AND a.symbol = b.symbol AND a.grp = b.grp AND a.slot = b.r1 JOIN rk c ON a.perm = c.perm AND a.symbol = c.symbol AND a.grp = c.grp AND a.slot = c.r2),
cl AS MATERIALIZED (SELECT *, c0 + sum(gap + rc) OVER (PARTITION BY perm, symbol ORDER BY i) AS lc FROM dr),
op AS MATERIALIZED (SELECT *, coalesce(lag(lc) OVER (PARTITION BY perm, symbol ORDER BY i), c0) + gap AS lo FROM cl),
permuted AS MATERIALIZED (SELECT 0 AS perm, symbol, i, ts, open, high, low, close, volume FROM bars UNION ALL SELECT p.perm, symbol, i, ts, open, high, low, close, volume FROM bars, (SELECT unnest(range(1, {PERMS + 1})) AS perm) p WHERE i = 0
 UNION ALL SELECT perm, symbol, i, ts, exp(lo), exp(lo + rh), exp(lo + rl), exp(lc), volume FROM op)"""


def _permuted(spark, sf_dir):
    return inference.permuted_bars(sessions.session_groups(_hourly(spark, sf_dir)), PERMS)


@query(f"{BASE}, {PERMUTED} SELECT CAST(perm AS INTEGER) AS perm, symbol, count(*) AS bars, round(sum(ln(close) * (i + 1)) / count(*), 3) AS path, round(sum(ln(high) - ln(low)), 4) AS span, round(sum(volume * (i % 7)), 2) AS dealt FROM permuted GROUP BY 1, 2")
def permuted_bars(spark, sf_dir):
    """Bars dealt anew within session groups, as rank-weighted sums of each draw."""
    return _permuted(spark, sf_dir).groupBy("perm", "symbol").agg(F.count("*").alias("bars"), rounded(F.sum(log("close") * (F.col("i") + 1)) / F.count("*"), 3).alias("path"), rounded(F.sum(log("high") - log("low")), 4).alias("span"), rounded(F.sum(F.col("volume") * (F.col("i") % 7)), 2).alias("dealt"))


def _cells(spark, sf_dir):
    w = Window.partitionBy("perm", "symbol").orderBy("i")
    x = _permuted(spark, sf_dir).withColumn("close", finite("close"))
    x = x.withColumn("mom", F.ln("close") - F.ln(F.lag("close", 3).over(w)))
    horizons = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("ret")) for h in (1, 4))))
    x = x.withColumn("r1", F.ln(F.lead("close", 1).over(w)) - F.ln("close")).withColumn("r4", F.ln(F.lead("close", 4).over(w)) - F.ln("close"))
    e = x.select("perm", "symbol", F.when(F.col("mom") > 0, 1).when(F.col("mom") < 0, -1).alias("side"), horizons.alias("o")).select("perm", "symbol", "side", "o.*").filter("side is not null")
    return inference.welch(e, "ret", ["perm", "symbol", "horizon"], 10).persist()  # a row for each draw and cell, read several times


CELLS = f"""{PERMUTED}, mo AS (SELECT perm, symbol, ln(close) - ln(lag(close, 3) OVER w) AS mom, ln(lead(close, 1) OVER w) - ln(close) AS r1, ln(lead(close, 4) OVER w) - ln(close) AS r4 FROM permuted WINDOW w AS (PARTITION BY perm, symbol ORDER BY i)),
lo2 AS (SELECT perm, symbol, sign(mom) AS side, 1 AS horizon, r1 AS ret FROM mo UNION ALL SELECT perm, symbol, sign(mom), 4, r4 FROM mo),
ce AS (SELECT perm, symbol, horizon, count(ret) FILTER (side = 1) AS nl, count(ret) FILTER (side = -1) AS ns, avg(ret) FILTER (side = 1) - avg(ret) FILTER (side = -1) AS d, sqrt(var_samp(ret) FILTER (side = 1) / nullif(count(ret) FILTER (side = 1), 0) + var_samp(ret) FILTER (side = -1) / nullif(count(ret) FILTER (side = -1), 0)) AS se FROM lo2 GROUP BY 1, 2, 3),
cells AS MATERIALIZED (SELECT perm, symbol, horizon, CASE WHEN nl >= 10 AND ns >= 10 AND se > 0 THEN d / se END AS t FROM ce)"""


@query(f"""{BASE}, {CELLS}, lim AS (SELECT symbol, horizon, quantile_cont(abs(t), 0.95) AS l FROM cells WHERE perm > 0 GROUP BY 1, 2),
re AS (SELECT c.symbol, c.horizon, abs(c.t) AS r, l FROM cells c JOIN lim USING (symbol, horizon) WHERE perm = 0 AND t IS NOT NULL),
pe AS (SELECT perm, max(abs(t)) AS most, count(*) FILTER (abs(t) > l AND EXISTS (SELECT 1 FROM re WHERE re.symbol = cells.symbol AND re.horizon = cells.horizon)) AS over FROM cells JOIN lim USING (symbol, horizon) WHERE perm > 0 GROUP BY 1),
ob AS (SELECT max(r) AS m, count(*) FILTER (r > l) AS k, count(*) AS live FROM re)
SELECT round(m, {DIGITS}) AS observed_max, k AS cells_over, live AS live_cells, count(*) AS permutations, round((1 + count(*) FILTER (most >= m)) / (1 + count(*)), {DIGITS}) AS p_max, round((1 + count(*) FILTER (over >= k)) / (1 + count(*)), {DIGITS}) AS p_count FROM pe, ob GROUP BY m, k, live""")
def family_pvalues(spark, sf_dir):
    """Family-wide tests of momentum cells against permuted markets."""
    return inference.family_pvalues(_cells(spark, sf_dir), ["symbol", "horizon"])


@query(f"""{BASE}, {CELLS}, re AS (SELECT symbol, horizon, t AS r FROM cells WHERE perm = 0 AND t IS NOT NULL)
SELECT symbol, horizon, round(r, {DIGITS}) AS t, round((1 + count(*) FILTER (abs(t) >= abs(r))) / (1 + count(*)), {DIGITS}) AS p_cell, round((r - avg(t)) / nullif(stddev_pop(t), 0), {DIGITS}) AS z FROM cells JOIN re USING (symbol, horizon) WHERE perm > 0 GROUP BY symbol, horizon, r""")
def cell_pvalues(spark, sf_dir):
    """Each cell against its own null."""
    return inference.cell_pvalues(_cells(spark, sf_dir), ["symbol", "horizon"])


def _vr_sql(source: str, frame: str, m: str, q: int) -> str:
    theta = " + ".join(f"{((2.0 * (q - j) / q) ** 2)!r} * coalesce(d2 * lag(d2, {j}) OVER w, 0)" for j in range(1, q))
    return f"""x AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, avg(r) OVER (PARTITION BY symbol) AS mu FROM {source}), y AS (SELECT *, (r - mu) * (r - mu) AS d2, CASE WHEN count(*) OVER f = {q} THEN sum(r) OVER f END AS qs FROM x WINDOW f AS ({frame} ROWS {q - 1} PRECEDING)),
z AS (SELECT *, {theta} AS th FROM y WINDOW w AS (PARTITION BY symbol ORDER BY i)), g AS (SELECT symbol, max(n) AS n, sum(d2) AS s2, sum((qs - {q} * mu) * (qs - {q} * mu)) AS sq, count(qs) AS windows, sum(th) AS th FROM z GROUP BY 1),
v AS (SELECT *, sq / ({m}) / nullif(s2 / (n - 1), 0) AS vr0 FROM g), result AS (SELECT symbol, n, windows, CASE WHEN n >= {4 * q} THEN vr0 END AS vr, CASE WHEN n >= {4 * q} THEN (vr0 - 1) / sqrt(th / (s2 * s2)) END AS m2 FROM v)"""


RETURNS = "ret AS (SELECT symbol, i, ln(close) - ln(before) AS r FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS before FROM bars) WHERE before IS NOT NULL)"


def _returns(spark, sf_dir):
    return _hourly(spark, sf_dir).withColumn("r", F.ln("close") - F.ln(lag("close"))).filter("r is not null")


@query(_sql(f"{BASE}, {RETURNS}, {_vr_sql('ret', 'PARTITION BY symbol ORDER BY i', '5 * (n - 5 + 1) * (1 - 5.0 / n)', 5)}", "symbol n windows", "vr m2"))
def variance_ratio(spark, sf_dir):
    """VR(5) over the whole series."""
    return inference.variance_ratio(_returns(spark, sf_dir).select("symbol", "i", "r"), 5)


@query(_sql(f"""{BASE}, {SESSIONS}, {RETURNS}, ac AS (SELECT ret.*, s.i - row_number() OVER (PARTITION BY ret.symbol ORDER BY ret.i) AS run FROM ret JOIN s USING (symbol, i) WHERE in_rth),
rl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS len FROM ac) WHERE len > 2), {_vr_sql('rl', 'PARTITION BY symbol, run ORDER BY i', '2 * windows', 2)}""", "symbol n windows", "vr m2"))
def segmented_variance_ratio(spark, sf_dir):
    """VR(2) with windows inside unbroken runs of regular hours."""
    x = sessions.with_sessions(_returns(spark, sf_dir))
    return inference.variance_ratio(inference.runs_of(x, F.col("in_rth"), 2).select("symbol", "i", "r", "run"), 2, segmented=True)


ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
PNL = "l_extendedprice * (l_discount - 0.05)"
#: Blocks of the query that has SQL, 70 splits; and the reference's, 12,870 splits.
BLOCKS, FULL_BLOCKS = 8, 16


def _lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("pnl", F.expr(PNL))


def _splits(spark, sf_dir, blocks=BLOCKS, parts=False):
    x = _lineitem(spark, sf_dir).groupBy((F.col("l_suppkey") % 9).alias("cfg"), F.expr("(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1").alias("t")).agg(F.sum("pnl").alias("pnl"))
    both = inference.block_sums(x, blocks), inference.combinations(spark, blocks)
    return both if parts else inference.cscv_splits(*both)


SPLITS = f"""tr AS (SELECT l_suppkey % 9 AS cfg, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, sum({PNL}) AS pnl FROM lineitem GROUP BY 1, 2), ln AS (SELECT (max(t) + 1) // {BLOCKS} AS len FROM tr),
bs AS (SELECT cfg, t // len AS block, count(*) AS n, sum(pnl) AS x, sum(pnl * pnl) AS xx FROM tr, ln WHERE t < len * {BLOCKS} GROUP BY 1, 2),
co AS (SELECT unnest(range(0, 256)) AS mask), cm AS (SELECT mask FROM co WHERE bit_count(mask) = 4),
gg AS (SELECT mask, cfg, (mask >> block) & 1 = 1 AS ins, sum(n) AS n, sum(x) AS x, sum(xx) AS xx FROM bs, cm GROUP BY 1, 2, 3),
me AS (SELECT mask, cfg, ins, (x / n) / nullif(sqrt(greatest((xx - x * x / n) / nullif(n - 1, 0), 0)), 0) AS m FROM gg),
mm AS (SELECT mask, cfg, max(m) FILTER (ins) AS a, max(m) FILTER (NOT ins) AS b FROM me GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY b NULLS FIRST, cfg) - (count(*) OVER (PARTITION BY mask) - count(b) OVER (PARTITION BY mask)) AS rk, count(b) OVER (PARTITION BY mask) AS known, row_number() OVER (PARTITION BY mask ORDER BY a DESC NULLS LAST, cfg) AS f FROM mm),
sp AS (SELECT a AS is_metric, b AS oos_metric, ln(w / (1 - w)) AS la FROM (SELECT *, greatest(least(rk / (known + 1), 1 - 1e-9), 1e-9) AS w FROM rr WHERE f = 1))"""


@query(f"WITH {SPLITS} SELECT count(*) AS combinations, round(avg(CASE WHEN la <= 0 THEN 1 ELSE 0 END), {DIGITS}) AS pbo, round(quantile_cont(la, 0.5), {DIGITS}) AS lambda_median, round(regr_slope(oos_metric, is_metric), {DIGITS}) AS slope, round(regr_intercept(oos_metric, is_metric), {DIGITS}) AS intercept, round(avg(CASE WHEN oos_metric < 0 THEN 1 ELSE 0 END), {DIGITS}) AS prob_oos_loss, round(quantile_cont(oos_metric, 0.5), {DIGITS}) AS oos_median, round(quantile_cont(is_metric, 0.5), {DIGITS}) AS is_median FROM sp")
def backtest_overfitting(spark, sf_dir):
    """Combinatorially symmetric cross-validation of monthly results, at the size of its SQL."""
    return inference.pbo(_splits(spark, sf_dir))


@query()
def backtest_overfitting_full(spark, sf_dir):
    """The same over all splits of 16 blocks (a test holds it against a plain version)."""
    return inference.pbo(_splits(spark, sf_dir, FULL_BLOCKS))


def _trades(spark, sf_dir):
    return _lineitem(spark, sf_dir).withColumn("r", F.col("pnl") / 100)


@query(f"""WITH t AS (SELECT l_returnflag, {PNL} AS pnl, greatest(least({PNL} / 100, 15), -15) AS r FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(r), 5) AS mean_r, round(quantile_cont(r, 0.5), 5) AS median_r, round(sum(r) FILTER (r > 0) / nullif(-sum(r) FILTER (r < 0), 0), 5) AS profit_factor, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 5) AS win_rate, round(sum(pnl), 2) AS total FROM t GROUP BY 1""")
def trade_stats(spark, sf_dir):
    """R statistics of trades."""
    return trading.trade_stats(_trades(spark, sf_dir), ["l_returnflag"], "pnl", "r").withColumn("total", rounded("total", 2))


@query(f"""WITH t AS (SELECT l_returnflag, {PNL} AS pnl, row_number() OVER (PARTITION BY l_returnflag ORDER BY {PNL} DESC, {ORDER}) AS k FROM lineitem),
g AS (SELECT l_returnflag, count(*) AS n, sum(pnl) AS total, sum(pnl) FILTER (k <= 5) AS top, sum(pnl) FILTER (pnl > 0) AS gross FROM t GROUP BY 1)
SELECT l_returnflag, n, round(total, 2) AS total, round(total - top, 2) AS without_top, round(top / gross, 5) AS top_share, CASE WHEN total > 0 AND total - top <= 0 THEN 'fail' WHEN top / gross > 0.5 THEN 'warn' ELSE 'pass' END AS verdict FROM g""")
def luck_battery(spark, sf_dir):
    """Concentration of the result in its best trades."""
    return trading.luck(_trades(spark, sf_dir), ["l_returnflag"], ORDER.split(", ")).withColumn("total", rounded("total", 2)).withColumn("without_top", rounded("without_top", 2))


@query(f"""WITH t AS (SELECT l_returnflag, sign({PNL}) AS s, lag(sign({PNL})) OVER (PARTITION BY l_returnflag ORDER BY {ORDER}) AS p FROM lineitem WHERE {PNL} <> 0),
g AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (s > 0) AS k, 1 + count(*) FILTER (p IS NOT NULL AND s <> p) AS runs FROM t GROUP BY 1), h AS (SELECT *, 2.0 * k * (n - k) / n + 1 AS mu FROM g)
SELECT l_returnflag, n, runs, round(mu, 5) AS expected_runs, round((runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)), 5) AS z FROM h""")
def runs_test(spark, sf_dir):
    """Do winners follow winners?"""
    return trading.runs_test(_trades(spark, sf_dir), ["l_returnflag"], ORDER.split(", "))


@query(f"""WITH d AS (SELECT l_returnflag, l_shipdate, sum({PNL}) AS pnl FROM lineitem GROUP BY 1, 2), e AS (SELECT *, sum(pnl) OVER w AS equity, CASE WHEN count(*) OVER l = 20 THEN sum(pnl) OVER l END AS roll_sum, CASE WHEN count(*) OVER l = 20 THEN avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER l END AS roll_win FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate), l AS (PARTITION BY l_returnflag ORDER BY l_shipdate ROWS 19 PRECEDING))
SELECT l_returnflag, l_shipdate, round(equity, 5) AS equity, round(equity - max(equity) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate), 5) AS drawdown, round(roll_sum, 5) AS roll_sum, round(roll_win, 5) AS roll_win FROM e""")
def equity_curves(spark, sf_dir):
    """Equity, drawdown and rolling results by day."""
    d = _trades(spark, sf_dir).groupBy("l_returnflag", "l_shipdate").agg(F.sum("pnl").alias("pnl"))
    return trading.equity(d, ["l_returnflag"], ["l_shipdate"]).select("l_returnflag", "l_shipdate", "equity", "drawdown", "roll_sum", "roll_win")


@query(f"""WITH s AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS y, avg({PNL}) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (ORDER BY x) AS rx, dense_rank() OVER (ORDER BY y) AS ry FROM s)
SELECT a.x, a.y, round(a.v, 5) AS v, count(*) AS neighbours, round(avg(b.v), 5) AS near_mean, round(min(b.v), 5) AS near_least FROM r a JOIN r b ON abs(a.rx - b.rx) + abs(a.ry - b.ry) = 1 GROUP BY a.x, a.y, a.v""")
def parameter_plateau(spark, sf_dir):
    """Neighbours of each cell of a parameter grid."""
    s = _lineitem(spark, sf_dir).groupBy(F.floor(F.col("l_quantity") / 10).alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y")).agg(F.avg("pnl").alias("v"))
    return trading.plateau(s, "x", "y", "v")


COSTS = [0.0, 1.0, 5.0, 20.0, 100.0]


@query(f"""WITH c AS (SELECT l_linestatus, cost, sum({PNL} - cost) AS total FROM lineitem, (SELECT unnest({COSTS}::DOUBLE[]) AS cost) GROUP BY 1, 2), n AS (SELECT *, lead(total) OVER w AS after, lead(cost) OVER w AS next_cost FROM c WINDOW w AS (PARTITION BY l_linestatus ORDER BY cost))
SELECT l_linestatus, cost, round(total, 2) AS total, CASE WHEN total > 0 AND after <= 0 THEN round(cost + (next_cost - cost) * total / (total - after), 5) END AS breakeven FROM n""")
def cost_sensitivity(spark, sf_dir):
    """Totals by cost and the cost that breaks even."""
    return account.cost_sensitivity(_trades(spark, sf_dir), COSTS, ["l_linestatus"]).withColumn("total", rounded("total", 2))


@query(f"""{BASE}, x AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM bars), u AS (SELECT symbol, arg_max(gap, {{'c': c, 'g': -gap}}) AS usual FROM (SELECT symbol, gap, count(*) AS c FROM x WHERE gap IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT symbol, count(*) AS bars, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS nulls, count(*) FILTER (high < greatest(open, close) - 1e-9 OR low > least(open, close) + 1e-9 OR high < low - 1e-9) AS insane, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (gap <> usual) AS odd_gaps, count(*) FILTER (volume <= 0) AS zero_volume FROM x LEFT JOIN u USING (symbol) GROUP BY 1)
SELECT symbol, name, n, verdict FROM (SELECT symbol, unnest([{{'name': 'nulls', 'n': nulls, 'verdict': CASE WHEN nulls > 0 THEN 'fail' ELSE 'pass' END}}, {{'name': 'insane', 'n': insane, 'verdict': CASE WHEN insane > 0 THEN 'fail' ELSE 'pass' END}}, {{'name': 'duplicates', 'n': duplicates, 'verdict': CASE WHEN duplicates > 0 THEN 'fail' ELSE 'pass' END}}, {{'name': 'odd_gaps', 'n': odd_gaps, 'verdict': CASE WHEN odd_gaps > 0 THEN 'warn' ELSE 'pass' END}}, {{'name': 'zero_volume', 'n': zero_volume, 'verdict': CASE WHEN zero_volume > 0.02 * bars THEN 'warn' ELSE 'pass' END}}], recursive := true) FROM g)""")
def bar_checks(spark, sf_dir):
    """The integrity battery."""
    return checks.bar_checks(_hourly(spark, sf_dir))


@query(f"WITH {TICKS}, {_bars_sql()}, {_bars_sql(86400, 'daily')} SELECT symbol, count(*) AS bars, CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS different FROM daily GROUP BY 1")
def cross_timeframe(spark, sf_dir):
    """Daily bars against the hourly bars within them."""
    return checks.cross_timeframe(_hourly(spark, sf_dir), src.event_bars(spark, sf_dir, 86400), 86400)


@query(f"""{BASE}, d AS (SELECT DISTINCT symbol, DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER) AS day FROM bars), g AS (SELECT *, day - lag(day) OVER (PARTITION BY symbol ORDER BY day) AS gap FROM d), h AS (SELECT symbol, count(*) AS days, min(day) AS a, max(day) AS b, max(gap) AS largest_gap FROM g GROUP BY 1)
SELECT symbol, days, CAST((SELECT count(*) FROM range(a::TIMESTAMP, b::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY) r(x) WHERE isodow(x) < 6) AS BIGINT) AS weekdays, CAST(largest_gap AS BIGINT) AS largest_gap FROM h""")
def data_coverage(spark, sf_dir):
    """Days present, weekdays expected, largest gap."""
    return checks.coverage(_hourly(spark, sf_dir))


QUOTED = f"""{TICKS}, qt AS (SELECT *, last_value(CASE WHEN type = 0 THEN price END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN type = 1 THEN price END IGNORE NULLS) OVER w AS ask, last_value(CASE WHEN type = 0 THEN size END IGNORE NULLS) OVER w AS bs, last_value(CASE WHEN type = 1 THEN size END IGNORE NULLS) OVER w AS az FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {QUOTED}, sp AS (SELECT symbol, ask - bid AS s FROM qt WHERE ask - bid > 0 AND ask - bid < 50) SELECT symbol, count(*) AS n, round(avg(s), 5) AS mean, round(quantile_cont(s, 0.5), 5) AS median, round(quantile_cont(s, 0.9), 5) AS p90, round(quantile_cont(s, 0.99), 5) AS p99 FROM sp GROUP BY 1")
def spread_summary(spark, sf_dir):
    """Quoted spreads from filled-forward bids and asks."""
    return checks.spread_summary(checks.quotes(src.event_ticks(spark, sf_dir)))


@query(f"""WITH {QUOTED}, pq AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bs) OVER w AS pbs, lag(az) OVER w AS pas FROM qt WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
f AS (SELECT *, CASE WHEN type < 2 AND pb IS NOT NULL AND pa IS NOT NULL THEN CASE WHEN bid >= pb THEN bs ELSE 0 END - CASE WHEN bid <= pb THEN pbs ELSE 0 END - CASE WHEN ask <= pa THEN az ELSE 0 END + CASE WHEN ask >= pa THEN pas ELSE 0 END END AS o, CASE WHEN type <> 2 THEN 0 WHEN abs(price - ask) <= 1e-8 + 1e-5 * abs(ask) THEN 1 WHEN abs(price - bid) <= 1e-8 + 1e-5 * abs(bid) THEN -1 ELSE 0 END AS sg FROM pq)
SELECT symbol, (ts // 3600) * 3600 AS ts, round(sum(o), 5) AS ofi, round(sum(sg * size), 5) AS signed_volume, round(sum(CASE WHEN type = 2 THEN size ELSE 0 END), 5) AS volume, round(avg(ask - bid), 5) AS mean_spread, count(*) AS updates FROM f GROUP BY 1, 2""")
def order_flow(spark, sf_dir):
    """Order-flow imbalance and signed volume by hour."""
    return checks.order_flow(checks.quotes(src.event_ticks(spark, sf_dir)))


def _features(spark, sf_dir):
    b = indicators.atr(_hourly(spark, sf_dir)).withColumn("mid9", indicators.mid_donchian(9)).withColumn("mid26", indicators.mid_donchian(26))
    up, down = inference.cross_events(F.col("mid9"), F.col("mid26"))
    x = sessions.with_sessions(b).withColumn("long", up).withColumn("short", down).withColumn("in_window", F.col("minutes").between(360, 1320))
    return x.join(indicators.super_trend(b.drop("atr", "tr")), ["symbol", "i"]).withColumn("trend_up", F.col("close") > F.col("super_trend"))


@query()
def simulated_trades(spark, sf_dir):
    """Trades of four exit presets (a state machine; tests hold it against hand-made cases)."""
    return trading.simulate(_features(spark, sf_dir), cost=0.1)


@query()
def marked_trades(spark, sf_dir):
    """The same trades marked to market bar by bar, by preset."""
    p = trading.bar_pnl(trading.simulate(_features(spark, sf_dir), cost=0.1), _hourly(spark, sf_dir), 0.1)
    return p.groupBy("symbol", "cfg").agg(F.count("*").alias("bars"), F.sum("pnl").alias("pnl"))


@query()
def account_evaluation(spark, sf_dir):
    """Chances of passing an account's rules when whole days are drawn at random."""
    t = _lineitem(spark, sf_dir).select(F.to_date("l_shipdate").alias("day"), "l_orderkey", "pnl")
    t = t.select("day", F.row_number().over(Window.partitionBy("day").orderBy("l_orderkey", "pnl")).cast("long").alias("exit_order"), (F.col("pnl") / 10).alias("pnl"), F.greatest(F.col("pnl") / 10, F.lit(0.0)).alias("mfe"), F.greatest(-F.col("pnl") / 10, F.lit(0.0)).alias("mae"))
    rule = {"mll": 2000.0, "lock": 0.0, "target": 3000.0, "consistency": 0.5, "dll": None, "min_days": 2, "realtime": True}
    days = account.day_results(t.select("day").distinct(), t, rule["dll"])
    return account.simulate_accounts(days, rule, 8_000).groupBy("status").agg(F.sum("accounts").alias("accounts"), F.avg("mean_day").alias("mean_day"))


from . import signal_queries  # noqa: E402, F401
from . import level_queries  # noqa: E402, F401
from . import conditioner_queries  # noqa: E402, F401
from . import report_queries  # noqa: E402, F401
from . import family_queries  # noqa: E402, F401
from . import ladder_queries  # noqa: E402, F401
