"""Registered queries of profiles, levels, breaks, anchors, touches and races."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators, inference, levels, sessions, signals
from ..sources import bars as src
from .registry import BASE, LOCAL, SESSIONS, TICKS, _hourly, _sql, query, rounded
from .signal_queries import PAIR_SQL, STEPS, recursion

#: Size of a price step, bars that make a session's profile usable on hourly bars, bars ahead in races, cost in points.
TICK, LEAST_BARS, HORIZON, COST = 5.0, 4, 8, 0.5

S7 = f"({LOCAL} + INTERVAL 7 HOURS)"
KEYS = {
    "ny": f"strftime({LOCAL} - INTERVAL 510 MINUTES, '%Y%m%d')", "session": f"strftime({S7}, '%Y%m%d')", "continuous": "'all'", "weekly": f"CAST(isoyear({S7}) AS VARCHAR) || 'W' || lpad(CAST(week({S7}) AS VARCHAR), 2, '0')",
    "monthly": f"strftime({S7}, '%Y%m')", "quarterly": f"CAST(year({S7}) AS VARCHAR) || 'Q' || CAST(quarter({S7}) AS VARCHAR)",
}
ANCHORED = f"""{SESSIONS}, ak AS (SELECT *, (high + low + close) / 3 AS tp, unnest([{', '.join(f"{{'kind': '{k}', 'anchor': {v}}}" for k, v in KEYS.items())}], recursive := true) FROM s),
a1 AS (SELECT *, first_value(tp) OVER w AS base, row_number() OVER w - 1 AS age FROM ak WINDOW w AS (PARTITION BY symbol, kind, anchor ORDER BY i)),
a2 AS (SELECT *, sum((tp - base) * volume) OVER b / nullif(sum(volume) OVER b, 0) AS m1, sum((tp - base) * (tp - base) * volume) OVER b / nullif(sum(volume) OVER b, 0) AS m2 FROM a1 WINDOW b AS (PARTITION BY symbol, kind, anchor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a3 AS (SELECT *, CASE WHEN age >= 5 AND m2 - m1 * m1 > 1e-9 THEN base + m1 END AS mu, CASE WHEN age >= 5 AND m2 - m1 * m1 > 1e-9 THEN sqrt(m2 - m1 * m1) END AS sigma FROM a2),
an AS MATERIALIZED (SELECT *, CAST(trunc(coalesce((close - mu) / sigma, 0)) AS INTEGER) AS zone FROM a3)"""


@query(_sql(f"{BASE}, {ANCHORED}, result AS (SELECT symbol, i, kind, age, zone, mu, sigma FROM an)", "symbol i kind age zone", "mu sigma"))
def anchored_bands(spark, sf_dir):
    """Causal bands of six kinds of anchor."""
    return levels.anchored_bands(_hourly(spark, sf_dir)).select("symbol", "i", "kind", "age", "zone", "mu", "sigma")


def _touch_sql(per: str, condition: str = "true", source: str = "an") -> str:
    return f"""tb AS (SELECT *, sign > 0 AS upper FROM (SELECT *, unnest([{', '.join(f"{{'k': {k}, 'sign': {s}}}" for k in (1, 2, 3, 4) for s in (-1, 1))}], recursive := true) FROM {source})),
th AS (SELECT *, CASE WHEN upper THEN close > mu + sign * k * sigma ELSE close < mu + sign * k * sigma END AS beyond FROM tb WHERE CASE WHEN upper THEN high >= mu + sign * k * sigma ELSE low <= mu + sign * k * sigma END),
ev AS MATERIALIZED (SELECT * FROM th WHERE {condition} QUALIFY row_number() OVER (PARTITION BY symbol, kind, {per}, k, sign ORDER BY i) = 1)"""


RACED = f"""rh AS (SELECT ev.*, b.i AS j, CASE WHEN sign < 0 THEN b.high >= mu ELSE b.low <= mu END AS ht, CASE WHEN sign < 0 THEN b.low <= mu + sign * (k + 1) * sigma ELSE b.high >= mu + sign * (k + 1) * sigma END AS hx, CASE WHEN sign < 0 THEN b.high >= mu - sign * k * sigma ELSE b.low <= mu - sign * k * sigma END AS ho
 FROM ev JOIN (SELECT symbol, max(i) AS last FROM bars GROUP BY 1) l ON l.symbol = ev.symbol AND ev.i + {HORIZON} <= last JOIN bars b ON b.symbol = ev.symbol AND b.i BETWEEN ev.i + 1 AND ev.i + {HORIZON}),
rt AS (SELECT *, coalesce(min(j) FILTER (ht) OVER p, 1e18) AS t FROM rh WINDOW p AS (PARTITION BY symbol, kind, grp, i, k, sign)),
rc AS (SELECT symbol, kind, grp, i, k, sign, any_value(in_rth) AS in_rth, any_value(mu) AS mu, any_value(sigma) AS sigma, any_value(close) AS close, min(t) AS t, coalesce(min(j) FILTER (hx), 1e18) AS x, coalesce(min(j) FILTER (ho), 1e18) AS o, coalesce(min(j) FILTER (hx AND j > t), 1e18) AS x2, coalesce(min(j) FILTER (ho AND j > t), 1e18) AS o2 FROM rt GROUP BY 1, 2, 3, 4, 5, 6),
rw AS (SELECT *, t < x AS a_win, x < 1e18 AND x <= t AS a_loss, t < 1e18 AND t = x AS tie, t < x AND o2 < x2 AS b_win, t < x AND x2 < 1e18 AND x2 <= o2 AS b_loss, o < x AS c_win, x < 1e18 AND x <= o AS c_loss, abs(mu - close) / sigma AS dm, abs(close - (mu + sign * (k + 1) * sigma)) / sigma AS de FROM rc)"""


def _table_sql(by: str, cost: float) -> str:
    return f"""rg AS (SELECT {by}, count(*) AS n, count(*) FILTER (a_win OR a_loss) AS nA, count(*) FILTER (b_win OR b_loss) AS nB, count(*) FILTER (c_win OR c_loss) AS nC, count(*) FILTER (a_win) AS a, count(*) FILTER (b_win) AS b, count(*) FILTER (c_win) AS c, count(*) FILTER (tie) AS ties, avg(dm) AS d_mean, avg(de) AS d_ext, avg(sigma) AS sigma, avg((de * sigma + {cost}) / nullif((dm + de) * sigma, 0)) AS pA_even FROM rw GROUP BY ALL),
tab AS (SELECT {by}, n, nA, nB, nC, a / nullif(nA, 0) AS pA, b / nullif(nB, 0) AS pB, c / nullif(nC, 0) AS pC, 1 - nA / n AS unresolved, ties / n AS ambiguous, d_mean, d_ext, sigma, pA_even FROM rg)"""


RACE_DOUBLES = "pA pB pC unresolved ambiguous d_mean d_ext sigma pA_even"
FAMILY = f"{ANCHORED}, {_touch_sql('session')}, {RACED.replace('grp', 'session')}, {_table_sql('kind, k, sign, in_rth', COST)}"


def _family(spark, sf_dir):
    banded = levels.anchored_bands(_hourly(spark, sf_dir))
    events = levels.touches(banded, (1, 2, 3, 4))
    return levels.race_table(levels.race_events(events, _hourly(spark, sf_dir), HORIZON), ["kind", "k", "sign", "in_rth"], COST)


@query(_sql(f"{BASE}, {FAMILY}, result AS (SELECT * FROM tab)", "kind k sign in_rth n nA nB nC", RACE_DOUBLES))
def band_races(spark, sf_dir):
    """Races after the first touch, for each anchor, band, side and part of the session, with their geometry."""
    return _family(spark, sf_dir).select("kind", "k", "sign", "in_rth", "n", "nA", "nB", "nC", *RACE_DOUBLES.split())


ECONOMICS = f"""ec0 AS (SELECT *, k * sign AS band, pA * d_mean * sigma - (1 - pA) * d_ext * sigma - {COST} AS ev_revert, (1 - pA) * d_ext * sigma - pA * d_mean * sigma - {COST} AS ev_extend, (d_mean * sigma + {COST}) / nullif(d_mean * sigma + d_ext * sigma, 0) AS even_extend FROM tab WHERE unresolved <= 0.6),
ec AS (SELECT *, greatest(ev_revert, ev_extend) AS ev_best, CASE WHEN ev_extend > ev_revert THEN 'extend' ELSE 'revert' END AS side FROM ec0)"""


@query(_sql(f"{BASE}, {FAMILY}, {ECONOMICS}, result AS (SELECT * FROM ec)", "kind in_rth band side", "ev_revert ev_extend even_extend ev_best"))
def band_economics(spark, sf_dir):
    """What reverting and extending earn at each band."""
    return levels.band_economics(_family(spark, sf_dir), COST, 0.6).select("kind", "in_rth", "band", "side", "ev_revert", "ev_extend", "even_extend", "ev_best")


@query(_sql(f"""{BASE}, {FAMILY}, {ECONOMICS}, sd AS (SELECT band, side, count(*) AS c FROM ec GROUP BY 1, 2), us AS (SELECT band, first(side ORDER BY c DESC, side) AS usual_side FROM sd GROUP BY 1),
result AS (SELECT band, usual_side, count(*) AS cells, count(DISTINCT kind) AS kinds, CAST(sum(nA) AS BIGINT) AS races, avg(pA) AS pA, avg(ev_best) AS ev_best FROM ec JOIN us USING (band) GROUP BY 1, 2)""", "band usual_side cells kinds races", "pA ev_best"))
def band_profile(spark, sf_dir):
    """The signed bands together, with the side most cells favour."""
    return levels.band_profile(levels.band_economics(_family(spark, sf_dir), COST, 0.6))


@query(_sql(f"""{BASE}, {ANCHORED}, {_touch_sql('session').replace('FROM an)', "FROM an WHERE kind = 'ny')")}, {RACED.replace('grp', 'session')},
zn AS (SELECT symbol, i, max(zone) FILTER (kind = 'weekly') AS zw, max(zone) FILTER (kind = 'monthly') AS zm FROM an GROUP BY 1, 2),
cf AS (SELECT rw.*, combo, CASE combo WHEN 'weekly' THEN abs(zw) >= 1 AND sign(zw) = rw.sign WHEN 'monthly' THEN abs(zm) >= 1 AND sign(zm) = rw.sign ELSE abs(zw) >= 1 AND sign(zw) = rw.sign AND abs(zm) >= 1 AND sign(zm) = rw.sign END AS agree FROM rw JOIN zn USING (symbol, i), (VALUES ('weekly'), ('monthly'), ('weekly+monthly')) v(combo)),
cg AS (SELECT k, sign, combo, count(*) FILTER (agree AND (a_win OR a_loss)) AS n_with, count(*) FILTER (NOT agree AND (a_win OR a_loss)) AS n_without, count(*) FILTER (agree AND a_win) AS w, count(*) FILTER (NOT agree AND a_win) AS o, avg(CASE WHEN agree THEN 1 ELSE 0 END) AS share FROM cf GROUP BY 1, 2, 3),
result AS (SELECT k, sign, combo, n_with, n_without, w / nullif(n_with, 0) AS p_with, o / nullif(n_without, 0) AS p_without, w / nullif(n_with, 0) - o / nullif(n_without, 0) AS diff, share FROM cg)""", "k sign combo n_with n_without", "p_with p_without diff share"))
def confluence(spark, sf_dir):
    """Do races differ where longer anchors lie in a zone on the same side?"""
    banded = levels.anchored_bands(_hourly(spark, sf_dir), ("ny", "weekly", "monthly"))
    raced = levels.race_events(levels.touches(banded.filter("kind = 'ny'"), (1, 2, 3, 4)), _hourly(spark, sf_dir), HORIZON)
    zones = banded.groupBy("symbol", "i").agg(*(F.max(F.when(F.col("kind") == k, F.col("zone"))).alias(f"zone_{k}") for k in ("weekly", "monthly")))
    same = lambda k: (F.abs(f"zone_{k}") >= 1) & (F.signum(f"zone_{k}") == F.col("sign"))
    combos = F.array(*(F.struct(F.lit(n).alias("combo"), c.alias("agree")) for n, c in (("weekly", same("weekly")), ("monthly", same("monthly")), ("weekly+monthly", same("weekly") & same("monthly")))))
    x = raced.join(zones, ["symbol", "i"]).withColumn("c", F.explode(combos)).select("*", "c.*")
    n = lambda c: F.sum(c.cast("long"))
    done, agree = F.col("a_win") | F.col("a_loss"), F.col("agree")
    g = x.groupBy("k", "sign", "combo").agg(n(agree & done).alias("n_with"), n(~agree & done).alias("n_without"), n(agree & F.col("a_win")).alias("w"), n(~agree & F.col("a_win")).alias("o"), F.avg(agree.cast("int")).alias("share"))
    a, b = F.try_divide("w", "n_with"), F.try_divide("o", "n_without")
    return g.select("k", "sign", "combo", "n_with", "n_without", a.alias("p_with"), b.alias("p_without"), (a - b).alias("diff"), "share")


BUCKET_SQL = "list_filter([" + ", ".join(f"CASE WHEN {'m >= ' + str(a) + ' OR m < ' + str(b) if a > b else 'm >= ' + str(a) + ' AND m < ' + str(b)} THEN '{k}' END" for k, (a, b) in levels.BUCKETS.items()) + "], lambda x: x IS NOT NULL)"
ARMS = "list_filter(['all', CASE WHEN beyond THEN 'accept' ELSE 'wick' END], lambda x: x IS NOT NULL)"


@query(_sql(f"""{BASE}, {ANCHORED}, ab AS (SELECT *, unnest({BUCKET_SQL}) AS bucket FROM an WHERE kind = 'ny'), {_touch_sql('anchor, bucket, arm', source='ab').replace('ELSE low <= mu + sign * k * sigma END),', 'ELSE low <= mu + sign * k * sigma END), ta AS (SELECT *, unnest(' + ARMS + ') AS arm FROM th),').replace('FROM th WHERE', 'FROM ta WHERE')},
{RACED.replace('symbol, kind, grp, i, k, sign', 'symbol, kind, bucket, arm, i, k, sign').replace('GROUP BY 1, 2, 3, 4, 5, 6)', 'GROUP BY 1, 2, 3, 4, 5, 6, 7)')}, {_table_sql('bucket, arm, k, sign', COST)},
result AS (SELECT a.bucket, a.k, a.sign, a.nA AS n_accept, w.nA AS n_wick, a.pA AS p_accept, w.pA AS p_wick, a.pA - w.pA AS diff FROM tab a JOIN tab w ON a.bucket = w.bucket AND a.k = w.k AND a.sign = w.sign WHERE a.arm = 'accept' AND w.arm = 'wick')""", "bucket k sign n_accept n_wick", "p_accept p_wick diff"))
def bucket_races(spark, sf_dir):
    """Races by part of the day: touches that close beyond the band against those that close back, for cells that have both."""
    banded = levels.anchored_bands(_hourly(spark, sf_dir), ("ny",)).withColumn("bucket", F.explode(levels.bucket_of(F.col("minutes"))))
    arms = [("all", F.lit(True)), ("accept", F.col("beyond")), ("wick", ~F.col("beyond"))]
    events = levels.union_all([levels.touches(banded, (1, 2, 3, 4), per=("anchor", "bucket"), condition=c).withColumn("arm", F.lit(a)) for a, c in arms])
    table = levels.race_table(levels.race_events(events, _hourly(spark, sf_dir), HORIZON), ["bucket", "arm", "k", "sign"], COST)
    a, w = (table.filter(F.col("arm") == arm).select("bucket", "k", "sign", F.col("nA").alias(f"n_{arm}"), F.col("pA").alias(f"p_{arm}")) for arm in ("accept", "wick"))
    return a.join(w, ["bucket", "k", "sign"]).withColumn("diff", F.col("p_accept") - F.col("p_wick"))


@query(_sql(f"""{BASE}, {STEPS}, {recursion('att', 'mv', {'a': ('(1.0/14)', 'x.tr')})}, {PAIR_SQL}, {ANCHORED.replace('FROM s)', 'FROM s)', 1)}, {_touch_sql('session').replace('FROM an)', "FROM an WHERE kind = 'session')").replace('(1, 2, 3, 4)', '(1, 2)')},
tc AS MATERIALIZED (SELECT pk.symbol, pk.i, pk.close, CASE WHEN df > 0 AND pdf <= 0 THEN 1 WHEN df < 0 AND pdf >= 0 THEN -1 ELSE 0 END AS cr, CASE WHEN lag(a) OVER w > 0 THEN lag(a) OVER w END AS atr, lead(close, 2) OVER w - close AS f2, lead(close, 4) OVER w - close AS f4, max(i) OVER (PARTITION BY pk.symbol) AS last FROM pk JOIN att USING (symbol, i) WINDOW w AS (PARTITION BY pk.symbol ORDER BY pk.i)),
e AS (SELECT ev.symbol, ev.i, ev.k, ev.sign, (SELECT min(j.i) FROM tc j WHERE j.symbol = ev.symbol AND j.i BETWEEN ev.i + 1 AND ev.i + 6 AND j.cr = -ev.sign) AS hit FROM ev JOIN tc ON tc.symbol = ev.symbol AND tc.i = ev.i WHERE ev.i + 10 <= tc.last AND ev.k <= 2),
ar AS (SELECT e.symbol, k, sign, CASE WHEN hit IS NULL THEN 'B' ELSE 'A' END AS arm, -sign * f2 / atr AS r2, -sign * f4 / atr AS r4 FROM e JOIN tc ON tc.symbol = e.symbol AND tc.i = coalesce(hit, e.i + 6)
 UNION ALL SELECT tc.symbol, k, ks.sign, 'C', -ks.sign * f2 / atr, -ks.sign * f4 / atr FROM tc JOIN (SELECT DISTINCT symbol, k, sign FROM ev WHERE k <= 2) ks ON ks.symbol = tc.symbol AND ks.sign = -tc.cr WHERE cr <> 0),
al AS (SELECT symbol, k, sign, arm, 2 AS horizon, r2 AS r FROM ar UNION ALL SELECT symbol, k, sign, arm, 4, r4 FROM ar),
ag AS (SELECT symbol, k, sign, horizon, count(*) FILTER (arm = 'A') AS nA, count(*) FILTER (arm = 'B') AS nB, count(*) FILTER (arm = 'C') AS nC, avg(r) FILTER (arm = 'A') AS mA, avg(r) FILTER (arm = 'B') AS mB, avg(r) FILTER (arm = 'C') AS mC FROM al WHERE r IS NOT NULL GROUP BY 1, 2, 3, 4),
result AS (SELECT *, mA - mB AS dA_B, mA - mC AS dA_C FROM ag)""", "symbol k sign horizon nA nB nC", "mA mB mC dA_B dA_C"))
def touch_then_cross(spark, sf_dir):
    """Touches that a cross back follows against those without, and against such crosses anywhere."""
    bars = signals.ema_pair(indicators.atr(_hourly(spark, sf_dir)), 8, 21)
    events = levels.touches(levels.anchored_bands(_hourly(spark, sf_dir), ("session",)), (1, 2))
    return levels.touch_then_cross(events, bars, signals.strict_crosses(F.col("fast"), F.col("slow")), 6, [2, 4])


PROFILE = f"""pb AS (SELECT *, CAST(floor(low / {TICK}) AS BIGINT) AS lo, CAST(ceil(high / {TICK}) AS BIGINT) AS hi FROM s WHERE in_rth),
pv AS (SELECT symbol, session, level, sum(part) AS vol FROM (SELECT symbol, session, unnest(range(lo, hi + 1)) AS level, volume / (hi - lo + 1) AS part FROM pb) GROUP BY 1, 2, 3),
pg AS (SELECT symbol, session, unnest(range(a, b + 1)) AS level FROM (SELECT symbol, session, min(lo) AS a, max(hi) AS b FROM pb GROUP BY 1, 2 HAVING count(*) >= {LEAST_BARS})),
pf AS MATERIALIZED (SELECT pg.*, round(coalesce(vol, 0), 9) AS vol FROM pg LEFT JOIN pv USING (symbol, session, level)),
p1 AS (SELECT *, sum(vol) OVER k AS total, count(*) OVER k AS n FROM pf WINDOW k AS (PARTITION BY symbol, session)),
p2 AS (SELECT *, coalesce(sum(vol) OVER (PARTITION BY symbol, session ORDER BY vol DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, first_value(level) OVER (PARTITION BY symbol, session ORDER BY vol DESC, level) AS poc, round(avg(vol) OVER (PARTITION BY symbol, session ORDER BY level ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS sm FROM p1 WHERE n >= 5 AND total > 0),
p3 AS (SELECT *, lag(sm) OVER w AS a, lead(sm) OVER w AS b, abs(level - poc) AS away FROM p2 WINDOW w AS (PARTITION BY symbol, session ORDER BY level)),
pl AS MATERIALIZED (SELECT symbol, session, max(poc) * {TICK} AS poc, max(level) FILTER (round(before, 6) < round(0.7 * total, 6)) * {TICK} AS vah, min(level) FILTER (round(before, 6) < round(0.7 * total, 6)) * {TICK} AS val, arg_min(level, {{'a': away, 'l': level}}) FILTER (sm > a AND sm >= b AND away > 2) * {TICK} AS hvn, arg_min(level, {{'a': away, 'l': level}}) FILTER (sm < a AND sm <= b) * {TICK} AS lvn FROM p3 GROUP BY 1, 2)"""


@query(_sql(f"{BASE}, {SESSIONS}, {PROFILE}, result AS (SELECT * FROM pl)", "symbol session", "poc vah val hvn lvn"))
def session_profiles(spark, sf_dir):
    """Point of control, value area and nodes of each session's bars."""
    return levels.profile_levels(levels.bar_profile(_hourly(spark, sf_dir), TICK, LEAST_BARS), TICK)


RTH_TICKS = f"""tl AS (SELECT symbol, ts // 86400 AS day, CAST(round_even(price / {TICK}, 0) AS BIGINT) AS level, sum(size) AS vol FROM ticks WHERE type = 2 AND hour({LOCAL}) * 60 + minute({LOCAL}) >= 510 AND hour({LOCAL}) * 60 + minute({LOCAL}) < 900 GROUP BY 1, 2, 3)"""


@query(_sql(f"""WITH RECURSIVE {TICKS}, {RTH_TICKS}, c0 AS (SELECT symbol, day, list(level ORDER BY level) AS ls, list(vol ORDER BY level) AS vs, sum(vol) AS total FROM tl GROUP BY 1, 2), c1 AS (SELECT *, list_position(vs, list_max(vs)) AS p FROM c0),
g AS (SELECT symbol, day, p AS lo, p AS hi, vs[p] AS acc FROM c1 UNION ALL SELECT symbol, day, CASE WHEN above >= below THEN lo ELSE lo - 1 END, CASE WHEN above >= below THEN hi + 1 ELSE hi END, acc + greatest(above, below) FROM (SELECT g.*, total, CASE WHEN hi < len(vs) THEN vs[hi + 1] ELSE -1 END AS above, CASE WHEN lo > 1 THEN vs[lo - 1] ELSE -1 END AS below FROM g JOIN c1 USING (symbol, day)) WHERE acc < 0.7 * total AND (above >= 0 OR below >= 0)),
z AS (SELECT symbol, day, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY 1, 2), result AS (SELECT symbol, day, len(ls) AS levels, ls[p] * {TICK} AS poc, ls[z.hi] * {TICK} AS vah, ls[z.lo] * {TICK} AS val, total AS total_volume FROM z JOIN c1 USING (symbol, day))""", "symbol day levels", "poc vah val total_volume"))
def tick_value_areas(spark, sf_dir):
    """Contiguous value area of regular-hours trades, by day."""
    t = src.event_ticks(spark, sf_dir)
    minutes = F.hour(sessions.local()) * 60 + F.minute(sessions.local())
    inside = t.filter((minutes >= sessions.RTH[0]) & (minutes < sessions.RTH[1]))
    return levels.contiguous_area(sessions.volume_profile(inside, TICK), TICK, ("symbol", "day"))


UNIT = "(CAST(('0x' || substr(md5(concat_ws(':', '0', symbol, session)), {}, 12)) AS BIGINT) + 1) / 281474976710656.0"
LEVEL_SQL = f"""{SESSIONS}, {PROFILE},
vw AS (SELECT *, sum(tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap, sum(tp * tp * volume) OVER w / nullif(sum(volume) OVER w, 0) AS sq FROM (SELECT *, (high + low + close) / 3 AS tp FROM s) WINDOW w AS (PARTITION BY symbol, session ORDER BY i)),
sw0 AS (SELECT *, CASE WHEN count(*) OVER a = 11 AND max(high) OVER a = high THEN high END AS ph, CASE WHEN count(*) OVER a = 11 AND min(low) OVER a = low THEN low END AS lw FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
sw1 AS (SELECT *, lag(ph, 5) OVER w AS lh, lag(lw, 5) OVER w AS ll FROM sw0 WINDOW w AS (PARTITION BY symbol ORDER BY i)), sw AS (SELECT symbol, i, last_value(lh IGNORE NULLS) OVER w AS swing_hi, last_value(ll IGNORE NULLS) OVER w AS swing_lo FROM sw1 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
dy AS (SELECT symbol, session, arg_max(close, i) AS last, max(high) - min(low) AS rng FROM s GROUP BY 1, 2),
dz AS (SELECT dy.symbol, dy.session, last_value(poc IGNORE NULLS) OVER b AS pd_poc, last_value(vah IGNORE NULLS) OVER b AS pd_vah, last_value(val IGNORE NULLS) OVER b AS pd_val, last_value(CASE WHEN poc IS NOT NULL THEN coalesce(hvn, -1e9) END IGNORE NULLS) OVER b AS hvn, last_value(CASE WHEN poc IS NOT NULL THEN coalesce(lvn, -1e9) END IGNORE NULLS) OVER b AS lvn, lag(last) OVER d AS pc, lag(rng) OVER d AS pr
 FROM dy LEFT JOIN pl ON pl.symbol = dy.symbol AND pl.session = dy.session WINDOW d AS (PARTITION BY dy.symbol ORDER BY dy.session), b AS (PARTITION BY dy.symbol ORDER BY dy.session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lw AS (SELECT vw.symbol, vw.i, vw.session, vw.in_rth, close, volume, high, low, pd_poc, pd_vah, pd_val, nullif(hvn, -1e9) AS hvn, nullif(lvn, -1e9) AS lvn, vwap, vwap + sqrt(greatest(sq - vwap * vwap, 0)) AS vwap_u1, vwap - sqrt(greatest(sq - vwap * vwap, 0)) AS vwap_d1,
 CASE WHEN m >= 630 THEN max(CASE WHEN m >= 510 AND m < 630 THEN high END) OVER k END AS or_hi, CASE WHEN m >= 630 THEN min(CASE WHEN m >= 510 AND m < 630 THEN low END) OVER k END AS or_lo, swing_hi, swing_lo,
 CASE WHEN pr > 0 THEN pc + 0.5 * sqrt(-2 * ln({UNIT.format(1)})) * cos(2 * pi() * {UNIT.format(13)}) * pr END AS rand FROM vw JOIN sw USING (symbol, i) JOIN dz USING (symbol, session) WINDOW k AS (PARTITION BY vw.symbol, vw.session)),
ll AS MATERIALIZED (SELECT symbol, i, session, in_rth, close, volume, high, low, unnest([{', '.join(f"{{'level': '{c}', 'value': {c}}}" for c in levels.LEVELS)}], recursive := true) FROM lw)"""


def _levels(spark, sf_dir):
    return levels.session_levels(_hourly(spark, sf_dir), TICK, LEAST_BARS, 120)


@query(f"{BASE}, {LEVEL_SQL} SELECT symbol, i, level, round(value, 3) AS value FROM ll")
def session_levels(spark, sf_dir):
    """Thirteen kinds of levels at every bar."""
    return _levels(spark, sf_dir).select("symbol", "i", "level", rounded("value", 3).alias("value"))


BREAKS = f"""bk0 AS (SELECT *, coalesce(close > value, false) AS above, value IS NOT NULL AS known FROM ll),
bk1 AS (SELECT *, known AND coalesce(lag(known) OVER w, false) AND above <> coalesce(lag(above) OVER w, false) AS broke FROM bk0 WINDOW w AS (PARTITION BY symbol, level ORDER BY i)),
bk2 AS (SELECT *, lag(broke, 3) OVER w AS entry, lag(above, 3) OVER w AS up, avg(CAST(above AS INTEGER)) OVER h AS t, sum(volume * CAST(above AS INTEGER)) OVER h / nullif(sum(volume) OVER h, 0) AS v FROM bk1 WINDOW w AS (PARTITION BY symbol, level ORDER BY i), h AS (PARTITION BY symbol, level ORDER BY i ROWS 2 PRECEDING)),
br AS MATERIALIZED (SELECT symbol, level, i, CASE WHEN up THEN 1 ELSE -1 END AS direction, CASE WHEN up THEN t ELSE 1 - t END AS acc_time, CASE WHEN up THEN v ELSE 1 - v END AS acc_vol FROM bk2 WHERE entry)"""


@query(_sql(f"{BASE}, {LEVEL_SQL}, {BREAKS}, result AS (SELECT * FROM br)", "symbol level i direction", "acc_time acc_vol"))
def level_breaks(spark, sf_dir):
    """Breaks of levels and how much of the next bars held beyond."""
    return levels.breaks(_levels(spark, sf_dir), 3)


@query(_sql(f"""{BASE}, {LEVEL_SQL}, {BREAKS}, fo AS (SELECT symbol, i, CASE WHEN count(*) OVER f = 4 AND max(high) OVER f > min(low) OVER f THEN max(high) OVER f - min(low) OVER f END AS rg, max(high) OVER f - close AS uh, close - min(low) OVER f AS ul, lead(close, 4) OVER w - close AS um, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i), f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
bo AS (SELECT br.symbol, level, br.i, acc_vol, br.i < floor(n * 0.5) AS calib, um * direction / rg AS ret, CASE WHEN direction > 0 THEN uh ELSE ul END / rg AS mfe, -CASE WHEN direction > 0 THEN ul ELSE uh END / rg AS mae FROM br JOIN fo USING (symbol, i)),
po AS (SELECT symbol, level, quantile_cont(acc_vol, [1.0/3, 2.0/3]) AS q FROM bo WHERE calib AND acc_vol IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
sd AS (SELECT level, CASE WHEN acc_vol >= q[2] THEN 1 WHEN acc_vol <= q[1] THEN -1 END AS side, unnest([{{'outcome': 'ret', 'x': ret}}, {{'outcome': 'mfe', 'x': mfe}}, {{'outcome': 'mae', 'x': mae}}], recursive := true) FROM bo JOIN po USING (symbol, level) WHERE NOT calib AND acc_vol IS NOT NULL),
g AS (SELECT level, outcome, count(x) FILTER (side = 1) AS n_long, count(x) FILTER (side = -1) AS n_short, avg(x) FILTER (side = 1) - avg(x) FILTER (side = -1) AS dd, sqrt(coalesce(var_samp(x) FILTER (side = 1) / nullif(count(x) FILTER (side = 1), 0), 0) + coalesce(var_samp(x) FILTER (side = -1) / nullif(count(x) FILTER (side = -1), 0), 0)) AS se FROM sd GROUP BY 1, 2),
result AS (SELECT level, outcome, n_long, n_short, CASE WHEN n_long >= 5 AND n_short >= 5 THEN dd END AS d, CASE WHEN n_long >= 5 AND n_short >= 5 AND se > 0 THEN dd / se END AS t FROM g)""", "level outcome n_long n_short", "d t"))
def level_acceptance(spark, sf_dir):
    """Accepted against rejected breaks, by thirds of the first half's volume share, in shares of the range that followed."""
    bars = _hourly(spark, sf_dir)
    out = levels.range_outcomes(bars.withColumn("calib", levels.calibration(0.5)), 4).join(bars.withColumn("calib", levels.calibration(0.5)).select("symbol", "i", "calib"), ["symbol", "i"])
    x = levels.directed(levels.breaks(_levels(spark, sf_dir), 3).join(out, ["symbol", "i"]))
    x = levels.terciles(x, "acc_vol", ["symbol", "level"], F.col("calib"), 5).filter("not calib")
    rows = x.select("level", "side", F.explode(F.array(*(F.struct(F.lit(c).alias("outcome"), F.col(c).alias("x")) for c in ("ret", "mfe", "mae")))).alias("o")).select("level", "side", "o.*")
    return inference.welch(rows, "x", ["level", "outcome"], 5)
