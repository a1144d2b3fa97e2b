"""Event statistics, permutations, family tests, variance ratios, cross-validated overfitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import series, ahead, full, lead, log, truth

WELCH = ["symbol", "cfg", "horizon"]


def cross_events(fast: Column, slow: Column, order=None) -> tuple[Column, Column]:
    """(up, down): the state changed at this bar, with both lines known here and before."""
    order = order or series()
    above = truth(fast > slow)
    known = fast.isNotNull() & slow.isNotNull() & F.lag(fast).over(order).isNotNull() & F.lag(slow).over(order).isNotNull()
    was = F.coalesce(F.lag(above).over(order), F.lit(False))
    return known & above & ~was, known & ~above & was


def forward_outcomes(bars: DataFrame, horizons: list[int], scale: str) -> DataFrame:
    """Long table (bar, horizon, ret, mfe, mae) of what follows a bar, in units of `scale`; null where the series ends."""
    parts = []
    for h in horizons:
        w = ahead(h)
        unit = F.when(F.col(scale) > 0, F.col(scale))
        parts.append(F.struct(F.lit(h).alias("horizon"), F.try_divide(lead("close", h) - F.col("close"), unit).alias("ret"), F.try_divide(full(F.max("high").over(w), "high", h, w) - F.col("close"), unit).alias("mfe"), F.try_divide(F.col("close") - full(F.min("low").over(w), "low", h, w), unit).alias("mae")))
    x = bars.withColumn("outcomes", F.array(*parts))
    return x.select(*bars.columns, F.explode("outcomes").alias("o")).select(*bars.columns, "o.*")


def welch(events: DataFrame, value: str = "ret", keys: list[str] = WELCH, least: int = 30) -> DataFrame:
    """Difference of means of long and short events and its t; null where either side has too few."""
    v, long, short = F.col(value), F.col("side") == 1, F.col("side") == -1
    g = events.groupBy(*keys).agg(*(f(F.when(s, v)).alias(n) for s, p in ((long, "l"), (short, "s")) for f, n in ((F.avg, f"mean_{p}"), (F.var_samp, f"var_{p}"), (F.count, f"n_{p}"))))
    enough = (F.col("n_l") >= least) & (F.col("n_s") >= least)
    se = F.sqrt(F.coalesce(F.try_divide("var_l", "n_l"), F.lit(0.0)) + F.coalesce(F.try_divide("var_s", "n_s"), F.lit(0.0)))
    d = F.col("mean_l") - F.col("mean_s")
    return g.select(*keys, F.col("n_l").alias("n_long"), F.col("n_s").alias("n_short"), F.when(enough, d).alias("d"), F.when(enough & (se > 0), F.try_divide(d, se)).alias("t"))


def permuted_bars(grouped: DataFrame, perms: int, seed: int = 1, start: int = 0, shared: bool = False) -> DataFrame:
    """Bars of `perms` draws and, as perm 0, the given ones.

    In log space each bar is a gap from the last close and a shape around its open. Shapes (with volume) and gaps are dealt
    anew, separately, among the bars of a symbol's group that come after bar `start`; time stamps stay, and so do the bars up
    to `start`. shared: all symbols are dealt alike. Order comes from md5, so it is the same in any engine and on any cluster.

    Groups 2k and 2k + 1 share a stretch of bars, the session k. Dealing within groups leaves a session's sums as they are, so
    each session starts from the close before it in the given market. A session is gathered into one row once; draws are made
    from that row, and no draw is shuffled.

    A price of 0 has a logarithm of minus infinity: lows of 0 are dealt on as such, and what follows an open or close of 0 in a
    draw's session is 0, infinite or NaN, but never left out."""
    s = Window.partitionBy("symbol").orderBy("i")
    lo = grouped.select("symbol", "group", "i", "ts", "volume", *(log(c).alias(f"l{c[0]}") for c in ("open", "high", "low", "close")))
    parts = lo.select("symbol", "group", "i", "ts", "volume", (F.col("lo") - F.lag("lc").over(s)).alias("gap"), (F.col("lh") - F.col("lo")).alias("rh"), (F.col("ll") - F.col("lo")).alias("rl"), (F.col("lc") - F.col("lo")).alias("rc"), F.lag("lc").over(s).alias("before"))
    rows = parts.filter(F.col("i") > start).groupBy("symbol", F.floor(F.col("group") / 2).alias("block")).agg(F.array_sort(F.collect_list(F.struct("group", "i", "ts", "gap", "rh", "rl", "rc", "volume"))).alias("rows"), F.min_by("before", "i").alias("base"))
    drawn = rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))

    def dealt(stream: int) -> Column:
        """The bars of each group in the order of a draw, one group after the other."""
        symbol = [] if shared else [F.col("symbol")]
        key = lambda r: F.md5(F.concat_ws(":", F.lit(seed), F.lit(stream), F.col("perm"), *symbol, r["i"]).cast("binary"))
        return F.transform(F.array_sort(F.transform("rows", lambda r: F.struct(r["group"].alias("group"), key(r).alias("h"), r["i"].alias("i"), r.alias("r")))), lambda x: x["r"])

    zipped = drawn.select("perm", "symbol", "base", F.arrays_zip(F.col("rows").alias("slot"), dealt(1).alias("shape"), dealt(2).alias("jump")).alias("z"))
    zipped = zipped.withColumn("z", F.transform(F.array_sort(F.transform("z", lambda z: F.struct(z["slot"]["i"].alias("i"), z.alias("z")))), lambda x: x["z"]))
    state = F.struct(F.col("base").alias("lc"), F.array().cast("array<struct<i:bigint,ts:bigint,lo:double,rh:double,rl:double,lc:double,volume:double>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        lo_, shape = acc["lc"] + z["jump"]["gap"], z["shape"]
        lc = lo_ + shape["rc"]
        row = F.struct(z["slot"]["i"].cast("bigint").alias("i"), z["slot"]["ts"].cast("bigint").alias("ts"), lo_.alias("lo"), shape["rh"].alias("rh"), shape["rl"].alias("rl"), lc.alias("lc"), shape["volume"].cast("double").alias("volume"))
        return F.struct(lc.alias("lc"), F.array_append(acc["out"], row).alias("out"))

    b = zipped.select("perm", "symbol", F.explode(F.aggregate("z", state, step, lambda acc: acc["out"])).alias("b")).select("perm", "symbol", "b.*")
    new = b.select("perm", "symbol", "i", "ts", F.exp("lo").alias("open"), F.exp(F.col("lo") + F.col("rh")).alias("high"), F.exp(F.col("lo") + F.col("rl")).alias("low"), F.exp("lc").alias("close"), "volume")
    real = grouped.select(F.lit(0).alias("perm"), "symbol", F.col("i").cast("long").alias("i"), F.col("ts").cast("long").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    head = real.filter(F.col("i") <= start).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms)))).select(*real.columns)
    return real.unionByName(head).unionByName(new)


def coarser_draws(draws: DataFrame, seconds: int) -> DataFrame:
    """Coarser bars of each draw from its own fine bars, so that the time frames of a draw belong together."""
    g = draws.withColumn("bar", F.floor(F.col("ts") / seconds) * seconds).groupBy("perm", "symbol", "bar").agg(F.min_by("open", "i").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "i").alias("close"), F.sum("volume").alias("volume"))
    return g.withColumnRenamed("bar", "ts").withColumn("i", F.row_number().over(Window.partitionBy("perm", "symbol").orderBy("ts")).cast("long") - 1)


def family_pvalues(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row of family tests from (keys, perm, t), perm 0 the real market: greatest |t|, and cells above the 95th percentile of
    their own null. All draws count, also those that lack a cell, and a live cell without a null stays in the greatest. Give cells that are kept (persisted): they are read several times."""
    null, real = cells.filter("perm > 0").withColumn("a", F.abs("t")), cells.filter("perm = 0 and t is not null").withColumn("r", F.abs("t")).select(*keys, "r")
    limit = null.groupBy(*keys).agg(F.percentile("a", 0.95).alias("limit"))
    judged = real.join(limit, keys, "left")
    above = lambda c: F.coalesce((F.col(c) > F.col("limit")).cast("long"), F.lit(0))
    perms = null.join(judged, keys, "left").groupBy("perm").agg(F.max("a").alias("most"), F.sum(F.when(F.col("r").isNotNull(), above("a")).otherwise(0)).alias("over"))
    seen = judged.agg(F.max("r").alias("observed_max"), F.sum(above("r")).alias("cells_over"), F.count("*").alias("live_cells"))
    # `seen` is one row, the family's own statistic.
    x = perms.join(F.broadcast(seen))
    return x.groupBy("observed_max", "cells_over", "live_cells").agg(F.count("*").alias("permutations"), ((1 + F.sum(F.coalesce((F.col("most") >= F.col("observed_max")).cast("long"), F.lit(0)))) / (1 + F.count("*"))).alias("p_max"), ((1 + F.sum((F.col("over") >= F.col("cells_over")).cast("long"))) / (1 + F.count("*"))).alias("p_count"))


def cell_pvalues(cells: DataFrame, keys: list[str], draws: int | None = None) -> DataFrame:
    """Share of draws at least as extreme, and deviation from the cell's own null mean in its standard deviations. draws: how
    many there were, for cells that some draws lack."""
    null, real = cells.filter("perm > 0"), cells.filter("perm = 0 and t is not null").select(*keys, F.col("t").alias("r"))
    x = real.join(null, keys, "left").groupBy(*keys, "r").agg(F.sum((F.abs("t") >= F.abs("r")).cast("long")).alias("k"), F.count("perm").alias("n"), F.avg("t").alias("m"), F.stddev_pop("t").alias("sd"))
    return x.select(*keys, F.col("r").alias("t"), ((1 + F.coalesce("k", F.lit(0))) / (1 + (F.lit(draws) if draws else F.col("n")))).alias("p_cell"), F.try_divide(F.col("r") - F.col("m"), "sd").alias("z"))


def runs_of(df: DataFrame, active: Column, least: int) -> DataFrame:
    """Rows of unbroken runs of more than `least` bars, with the run's id and length."""
    x = df.filter(active).withColumn("run", F.col("i") - F.row_number().over(series()))
    x = x.withColumn("run_length", F.count("*").over(Window.partitionBy("symbol", "run")))
    return x.filter(F.col("run_length") > least)


def variance_ratio(returns: DataFrame, q: int, segmented: bool = False) -> DataFrame:
    """VR(q) and its heteroskedasticity-robust statistic per symbol from (symbol, i, r); segmented: windows stay within `run`."""
    seq = Window.partitionBy("symbol").orderBy("i")
    x = returns.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("mu", F.avg("r").over(Window.partitionBy("symbol"))).withColumn("d2", F.pow(F.col("r") - F.col("mu"), 2))
    frame = (Window.partitionBy("symbol", "run").orderBy("i") if segmented else seq).rowsBetween(-(q - 1), 0)
    x = x.withColumn("qsum", full(F.sum("r").over(frame), "r", q, frame))
    theta = reduce(lambda a, b: a + b, [((2.0 * (q - j) / q) ** 2) * F.coalesce(F.col("d2") * F.lag("d2", j).over(seq), F.lit(0.0)) for j in range(1, q)])
    g = x.withColumn("th", theta).groupBy("symbol").agg(F.max("n").alias("n"), F.sum("d2").alias("s2"), F.sum(F.pow(F.col("qsum") - q * F.col("mu"), 2)).alias("sq"), F.count("qsum").alias("windows"), F.sum("th").alias("th"))
    m = q * F.col("windows") if segmented else q * (F.col("n") - q + 1) * (1 - q / F.col("n"))
    vr = F.try_divide(F.try_divide(F.col("sq"), m), F.try_divide(F.col("s2"), F.col("n") - 1))
    enough = F.col("n") >= 4 * q
    return g.select("symbol", "n", "windows", F.when(enough, vr).alias("vr"), F.when(enough, F.try_divide(vr - 1, F.sqrt(F.try_divide(F.col("th"), F.col("s2") * F.col("s2"))))).alias("m2"))


def block_sums(trials: DataFrame, blocks: int) -> DataFrame:
    """(cfg, block) sums that the Sharpe ratio needs, from (cfg, t, pnl) with t from 0; rows beyond equal blocks are dropped."""
    length = F.floor((F.col("last") + 1) / blocks)
    x = trials.join(F.broadcast(trials.agg(F.max("t").alias("last"))))  # one row: how long the trials are
    x = x.withColumn("length", length)
    return x.filter(F.col("t") < F.col("length") * blocks).groupBy("cfg", F.floor(F.col("t") / F.col("length")).alias("block")).agg(F.count("*").alias("n"), F.sum("pnl").alias("x"), F.sum(F.col("pnl") * F.col("pnl")).alias("xx"))


def combinations(spark, blocks: int) -> DataFrame:
    """(combo, block, inside) for every choice of half the blocks."""
    masks = spark.range(1 << blocks).filter(F.bit_count("id") == blocks // 2).select(F.col("id").cast("int").alias("combo"))
    return masks.select("combo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).withColumn("inside", F.getbit("combo", F.col("block").cast("int")) == 1)


def split_metrics(sums: DataFrame, combos: DataFrame, metric: str = "sharpe") -> DataFrame:
    """(combo, cfg, is_metric, oos_metric): each configuration on both sides of each split, from sums of blocks, so that a split
    costs blocks * configurations rows and not a pass over the trials. metric: sharpe or mean."""
    g = sums.join(F.broadcast(combos), "block").groupBy("combo", "cfg", "inside").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    mean = F.col("x") / F.col("n")
    sharpe = F.try_divide(mean, F.sqrt(F.greatest(F.try_divide(F.col("xx") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0))))
    m = g.withColumn("m", {"sharpe": sharpe, "mean": mean}[metric])
    return m.groupBy("combo", "cfg").agg(F.max(F.when(F.col("inside"), F.col("m"))).alias("is_metric"), F.max(F.when(~F.col("inside"), F.col("m"))).alias("oos_metric"))


def split_winners(metrics: DataFrame) -> DataFrame:
    """Per split: the in-sample winner, its metrics on both sides and the logit of its rank out of sample."""
    known = F.count("oos_metric").over(Window.partitionBy("combo"))
    rank = F.row_number().over(Window.partitionBy("combo").orderBy(F.asc_nulls_first("oos_metric"), "cfg")) - (F.count("*").over(Window.partitionBy("combo")) - known)
    x = metrics.withColumn("w", F.greatest(F.least(rank / (known + 1), F.lit(1 - 1e-9)), F.lit(1e-9))).withColumn("mean_oos", F.avg("oos_metric").over(Window.partitionBy("combo")))
    best = x.withColumn("first", F.row_number().over(Window.partitionBy("combo").orderBy(F.desc_nulls_last("is_metric"), "cfg"))).filter("first = 1 and is_metric is not null")
    return best.select("combo", F.col("cfg").alias("winner"), "is_metric", "oos_metric", "mean_oos", F.ln(F.col("w") / (1 - F.col("w"))).alias("lambda"))


def cscv_splits(sums: DataFrame, combos: DataFrame, metric: str = "sharpe") -> DataFrame:
    return split_winners(split_metrics(sums, combos, metric))


def pbo(splits: DataFrame) -> DataFrame:
    """Probability of backtest overfitting and what goes with it, over all splits."""
    return splits.agg(F.count("*").alias("combinations"), F.avg((F.col("lambda") <= 0).cast("int")).alias("pbo"), F.percentile("lambda", 0.5).alias("lambda_median"), F.regr_slope("oos_metric", "is_metric").alias("slope"), F.regr_intercept("oos_metric", "is_metric").alias("intercept"), F.avg((F.col("oos_metric") < 0).cast("int")).alias("prob_oos_loss"), F.percentile("oos_metric", 0.5).alias("oos_median"), F.percentile("is_metric", 0.5).alias("is_median"))


def slice_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The count test of a family and of its slices by each key alone, by grouping sets over one pass of the judged cells.
    Slices that a key does not cut show `all` or 0 for it."""
    null = cells.filter("perm > 0")
    limits = null.groupBy(*keys).agg(F.percentile(F.abs("t"), 0.95).alias("limit"))
    live = cells.filter("perm = 0 and t is not null").select(*keys).join(limits, keys)
    judged = cells.join(live, keys).withColumn("above", F.coalesce((F.abs("t") > F.col("limit")).cast("long"), F.lit(0)))
    sets = [["perm"], *(["perm", k] for k in keys)]
    counts = judged.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in ["perm", *keys])).agg(F.sum("above").alias("over"))
    kinds = dict(cells.dtypes)
    named = counts.select("perm", "over", *(F.coalesce(F.col(k), F.lit("all") if kinds[k] == "string" else F.lit(0)).alias(k) for k in keys))
    seen = named.filter("perm = 0").select(*keys, F.col("over").alias("seen"))
    g = named.filter("perm > 0").join(seen, keys).groupBy(*keys, "seen").agg(F.count("*").alias("n"), F.sum((F.col("over") >= F.col("seen")).cast("long")).alias("k"))
    return g.select(*keys, F.col("seen").alias("cells_over"), ((1 + F.col("k")) / (1 + F.col("n"))).alias("p_count"))


def winner_support(cells: DataFrame, market: str, keys: list[str]) -> DataFrame:
    """The cell with the largest |t|, against the median of its market's other cells, and the same cell on the other markets:
    they agree if all have its sign and one of them reaches 1.5. cells: one row for each market and keys."""
    live = cells.filter("t is not null").select(market, *keys, "t")
    best = live.orderBy(F.desc(F.abs("t")), market, *keys).limit(1).select(F.col(market).alias("w_market"), *(F.col(k).alias(f"w_{k}") for k in keys), F.col("t").alias("w_t"))
    same_cell = F.lit(True)
    for k in keys:
        same_cell = same_cell & (F.col(k) == F.col(f"w_{k}"))
    # One row, the winner, goes to the cells.
    x = live.join(F.broadcast(best)).withColumn("same_cell", same_cell).withColumn("same_market", F.col(market) == F.col("w_market"))
    peer, other = F.when(F.col("same_market") & ~F.col("same_cell"), F.abs("t")), F.col("same_cell") & ~F.col("same_market")
    g = x.groupBy("w_market", *(f"w_{k}" for k in keys), "w_t").agg(F.percentile(peer, 0.5).alias("peer_median"), F.count(F.when(other, 1)).alias("others"), F.min(F.when(other, (F.signum("t") == F.signum("w_t")).cast("int"))).alias("same"), F.max(F.when(other, F.abs("t"))).alias("most"))
    return g.select(F.col("w_market").alias(market), *(F.col(f"w_{k}").alias(k) for k in keys), F.col("w_t").alias("winner_t"), "peer_median", F.try_divide(F.abs("w_t"), F.col("peer_median")).alias("peer_ratio"), "others", F.coalesce((F.col("same") == 1) & (F.col("most") >= 1.5), F.lit(False)).alias("others_agree"))


def signed_pvalues(cells: DataFrame, keys: list[str], value: str = "vr") -> DataFrame:
    """One-sided: the share of draws at or below the real market's value."""
    real = cells.filter("perm = 0").select(*keys, F.col(value).alias("seen"))
    g = cells.filter("perm > 0").join(real, keys).groupBy(*keys, "seen").agg(F.count("*").alias("n"), F.sum((F.col(value) <= F.col("seen")).cast("long")).alias("k"))
    return g.select(*keys, F.col("seen").alias(value), ((1 + F.coalesce("k", F.lit(0))) / (1 + F.col("n"))).alias("p_below"))


def deviation_difference(cells: DataFrame, keys: list[str], arm: str, first: str, second: str, value: str) -> DataFrame:
    """Difference of two arms' deviations from their own null means, for the market and every draw: what their starting
    geometry alone would make of them is taken out."""
    mean = cells.filter("perm > 0").groupBy(*keys, arm).agg(F.avg(value).alias("mean"))
    x = cells.join(mean, [*keys, arm]).withColumn("dev", F.col(value) - F.col("mean"))
    g = x.groupBy("perm", *keys).agg(F.max(F.when(F.col(arm) == first, F.col("dev"))).alias("a"), F.max(F.when(F.col(arm) == second, F.col("dev"))).alias("b"))
    return g.select("perm", *keys, (F.col("a") - F.col("b")).alias("t"))
