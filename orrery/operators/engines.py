"""Signal engines on window rows or window arrays: one row a (cohort, signal_id, k).

Aggregates run on exploded window rows (partial aggregation, no array is built); formulas that need order or pairs
run on the window's array. A window too short for an engine gives NULL in its columns, the row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import windows as W

KEYS = ("cohort", "signal_id", "k")


def lagged(obs: DataFrame, *lags: int) -> DataFrame:
    """Indexed rows with d<lag> = value - value `lag` rows earlier: differences are taken once per sample, not per window."""
    rows = W.indexed(obs)
    order = W.series().orderBy("signal_0")
    return rows.withColumns({f"d{k}": F.col("value") - F.lag("value", k).over(order) for k in lags})


def flat(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


def statistics(rows: DataFrame) -> DataFrame:
    """Population excess kurtosis, skewness, crest factor; four samples at least."""
    v, n = F.col("value"), F.count("value")
    crest = F.max(F.abs(v)) / F.nullif(F.sqrt(F.avg(v * v)), F.lit(0.0))
    return rows.groupBy(*KEYS).agg(
        A.when_enough(n, 4, F.kurtosis(v)).alias("kurtosis"), A.when_enough(n, 4, F.skewness(v)).alias("skewness"), A.when_enough(n, 4, crest).alias("crest_factor")
    )


def peak_rms(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    return rows.groupBy(*KEYS).agg(F.max(F.abs(v)).alias("peak"), (F.max(v) - F.min(v)).alias("peak_to_peak"), F.sqrt(F.avg(v * v)).alias("rms"))


def trend(rows: DataFrame) -> DataFrame:
    """OLS on the place in the window; population deviation of the residual; range of the centred running sum."""
    inside = Window.partitionBy(*KEYS)
    c = rows.withColumn("m", F.avg("value").over(inside))
    c = c.withColumn("c", F.sum(F.col("value") - F.col("m")).over(inside.orderBy("i")))
    level = F.var_pop("value") > 1e-20
    r2 = F.when(level, F.regr_r2("value", "i")).otherwise(0.0)
    return c.groupBy(*KEYS).agg(
        F.regr_slope("value", "i").alias("trend_slope"), r2.alias("trend_r2"),
        F.sqrt(F.greatest(F.var_pop("value") * (1 - r2), F.lit(0.0))).alias("detrend_std"),
        (F.max("c") - F.min("c")).alias("cusum_range"),
    )


def rate_of_change(rows: DataFrame) -> DataFrame:
    """Statistics of first differences, plain and in units of the window's deviation. rows: with d1."""
    d = F.when(F.col("i") > 0, F.col("d1"))
    sd = F.nullif(F.stddev_pop("value"), F.lit(0.0))
    return rows.groupBy(*KEYS).agg(
        F.avg(d).alias("mean_rate"), F.max(d).alias("max_rate"), F.min(d).alias("min_rate"), F.stddev_pop(d).alias("rate_std"), F.max(F.abs(d)).alias("abs_max_rate"),
        (F.avg(d) / sd).alias("mean_roc"), (F.stddev_pop(d) / sd).alias("std_roc"), (F.max(F.abs(d)) / sd).alias("max_roc"),
    )


def variance_ratio(rows: DataFrame) -> DataFrame:
    """Var of q-differences over q times Var of differences (sample variances), and its z for q = 2."""
    one = F.nullif(F.var_samp(F.when(F.col("i") >= 1, F.col("d1"))), F.lit(0.0))
    vr = {q: F.coalesce(F.var_samp(F.when(F.col("i") >= q, F.col(f"d{q}"))) / (one * q), F.lit(1.0)) for q in (2, 4, 8)}
    z = (vr[2] - 1) / F.sqrt(F.lit(2.0) / (F.count("value") - 1))
    return rows.groupBy(*KEYS).agg(vr[2].alias("variance_ratio"), vr[4].alias("variance_ratio_4"), vr[8].alias("variance_ratio_8"), z.alias("variance_ratio_stat"))


def acf_decay(windows: DataFrame, half: float = 0.5) -> DataFrame:
    """Autocorrelation at lags 1 and 10 and the first lag below one half, up to min(50, n / 2). windows: arrays x."""
    x, n = F.col("x"), F.size("x")
    w = windows.withColumn("c", F.transform(x, lambda v: v - A.mean(x))).withColumn("v0", A.total(F.transform("c", lambda v: v * v)))
    c = F.col("c")
    acf = lambda lag: A.total(F.zip_with(F.slice(c, 1, n - lag), F.slice(c, lag + 1, n - lag), lambda a, b: a * b)) / F.nullif(F.col("v0"), F.lit(0.0))
    lags = F.sequence(F.lit(1), F.least(F.lit(50), F.floor(n / 2).cast("int")))
    w = w.withColumn("acf", F.transform(lags, acf))
    below = F.array_position(F.transform("acf", lambda a: a < half), True)
    return w.select(*KEYS, F.try_element_at("acf", F.lit(1)).alias("acf_lag1"), F.try_element_at("acf", F.lit(10)).alias("acf_lag10"), F.nullif(below, F.lit(0)).cast("double").alias("acf_half_life"))


def variance_growth(windows: DataFrame) -> DataFrame:
    """Slope of log variance of the running sum's head on log length over n/8, n/4, n/2, n; variance of the whole over
    twice that of the first half."""
    n = F.size("x")
    w = windows.withColumn("s", A.running(F.col("x")))
    var = lambda k: A.moments(F.slice("s", 1, k), A.mean(F.slice("s", 1, k)), 2)
    for q in (8, 4, 2, 1):
        w = w.withColumn(f"k{q}", F.floor(n / q).cast("int"))
    for q in (8, 4, 2, 1):
        w = w.withColumn(f"v{q}", var(F.col(f"k{q}")))
    good = F.filter(F.array(*(F.struct(F.ln(F.col(f"k{q}").cast("double")).alias("a"), F.ln(F.nullif(F.col(f"v{q}"), F.lit(0.0))).alias("b"), F.col(f"k{q}").alias("k")) for q in (8, 4, 2, 1))), lambda p: (p["k"] >= 4) & p["b"].isNotNull())
    w = w.withColumn("p", good).withColumn("ma", A.mean(F.transform("p", lambda p: p["a"]))).withColumn("mb", A.mean(F.transform("p", lambda p: p["b"])))
    sab = A.total(F.transform("p", lambda p: (p["a"] - F.col("ma")) * (p["b"] - F.col("mb"))))
    saa = A.total(F.transform("p", lambda p: (p["a"] - F.col("ma")) * (p["a"] - F.col("ma"))))
    slope = F.when(F.size("p") >= 2, sab / F.nullif(saa, F.lit(0.0)))
    return w.select(*KEYS, slope.alias("variance_growth_rate"), (F.col("v1") / F.nullif(F.col("v2"), F.lit(0.0)) / 2).alias("variance_ratio"))


def pulsation(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    spread = F.max(v) - F.min(v)
    return rows.groupBy(*KEYS).agg((spread / (F.abs(F.avg(v)) + 1e-10)).alias("pulsation_index"), F.avg(v).alias("flow_mean"), spread.alias("flow_range"))


def time_constant(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Decay time from the log-linear fit, where at least `share` of the non-zero steps go one way. rows: with d1."""
    inside = Window.partitionBy(*KEYS)
    c = rows.withColumn("ly", F.ln(F.col("value") - F.min("value").over(inside) + 1e-10)).withColumn("m", F.count("*").over(inside))
    d = F.when(F.col("i") > 0, F.col("d1"))
    up, down = F.sum((d > 0).cast("int")), F.sum((d < 0).cast("int"))
    edge = F.greatest(F.floor(F.col("m") / 10), F.lit(1))
    out = c.groupBy(*KEYS).agg(
        F.greatest(up, down).alias("most"), (up + down).alias("moves"), F.regr_slope("ly", "i").alias("s"), F.regr_r2("ly", "i").alias("r2"),
        F.min("value").alias("low"), F.avg(F.when(F.col("i") < edge, F.col("value"))).alias("head"),
        F.avg(F.when(F.col("i") >= F.col("m") - edge, F.col("value"))).alias("tail"), F.count("*").alias("n"),
    )
    ok = (F.col("n") >= 10) & (F.col("moves") >= 2) & (F.col("most") >= share * F.col("moves")) & (F.abs("s") >= 1e-15)
    return out.select(
        *KEYS, F.when(ok, F.abs(1 / F.nullif(F.col("s"), F.lit(0.0)))).alias("time_constant"), F.when(ok, F.col("tail")).alias("equilibrium_value"),
        F.when(ok, F.col("r2")).alias("fit_r2"), F.when(ok, (F.col("head") > F.col("tail")).cast("double")).alias("is_decay"),
    )


def basin(rows: DataFrame, bins: int = 20, least: int = 100) -> DataFrame:
    """Greatest share of a bin, share of bin changes, bins holding over half their even share."""
    inside = Window.partitionBy(*KEYS)
    lo, hi = F.min("value").over(inside), F.max("value").over(inside)
    step = F.nullif(hi - lo, F.lit(0.0)) / bins
    c = rows.withColumn("bin", F.coalesce(F.least(F.floor((F.col("value") - lo) / step), F.lit(bins - 1)), F.lit(0)))
    c = c.withColumn("moved", (F.col("bin") != F.lag("bin").over(inside.orderBy("i"))).cast("int"))
    per = c.groupBy(*KEYS, "bin").agg(F.count("*").alias("m"), F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"))
    out = per.groupBy(*KEYS).agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.sum("moved").alias("moved"), F.collect_list("m").alias("ms"))
    n = F.col("n")
    busy = F.size(F.filter("ms", lambda m: m > n / bins * 0.5))
    return out.select(
        *KEYS, F.when(n >= least, F.col("most") / n).alias("basin_stability"), F.when(n >= least, F.col("moved") / (n - 1)).alias("transition_prob"), F.when(n >= least, busy).cast("double").alias("n_attractors")
    )


def mann_kendall(windows: DataFrame) -> DataFrame:
    """z of the sum of signs over all pairs (with continuity correction, no ties correction) and the Theil-Sen slope."""
    x, n = F.col("x"), F.size("x")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(F.signum(F.get(x, j - 1) - F.get(x, i - 1)).alias("s"), ((F.get(x, j - 1) - F.get(x, i - 1)) / (j - i)).alias("b"))),
        )
    )
    w = windows.filter(n >= 2).withColumn("p", pairs)
    s = A.total(F.transform("p", lambda p: p["s"]))
    var = n * (n - 1) * (2 * n + 5) / 18.0
    z = F.when(s > 0, (s - 1) / F.sqrt(var)).when(s < 0, (s + 1) / F.sqrt(var)).otherwise(0.0)
    return w.select(*KEYS, A.when_enough(n, 10, z).alias("mk_stat"), A.when_enough(n, 10, A.median(F.transform("p", lambda p: p["b"]))).alias("mk_slope"))


def cycle_counting(windows: DataFrame) -> DataFrame:
    """Half cycles between turning points; accumulation is half the sum of cubed relative ranges."""
    x, n = F.col("x"), F.size("x")
    turn = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (i == n) | ((F.get(x, i - 1) - F.get(x, i - 2)) * (F.get(x, i) - F.get(x, i - 1)) < 0),
    )
    w = windows.filter(n >= 4).withColumn("t", F.transform(turn, lambda i: F.get(x, i - 1))).withColumn("r", F.transform(A.diffs(F.col("t")), F.abs))
    m, most = F.size("r"), F.nullif(F.array_max("r"), F.lit(0.0))
    return w.select(
        *KEYS, (F.floor(m / 2) + m % 2).cast("long").alias("n_cycles"), F.floor(m / 2).cast("long").alias("n_full_cycles"), (m % 2).cast("long").alias("n_half_cycles"),
        most.alias("max_range"), A.mean(F.col("r")).alias("mean_range"), (A.total(F.transform("r", lambda v: (v / most) * (v / most) * (v / most))) * 0.5).alias("cycle_accumulation"),
    )


def levels(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Adds lev: with more than `bins` distinct values, right-closed equal bins (the minimum alone in 0); else the rank."""
    inside = Window.partitionBy(*KEYS)
    lo, hi = F.min("value").over(inside), F.max("value").over(inside)
    distinct = F.size(F.collect_set("value").over(inside))
    rows = rows.withColumn("many", distinct > bins).withColumn("rank", F.dense_rank().over(inside.orderBy("value")) - 1)
    cell = F.ceil((F.col("value") - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)))
    return rows.withColumn("lev", F.when(F.col("many"), F.least(cell, F.lit(bins))).otherwise(F.col("rank"))).withColumn("n_values", distinct)


def _plogp(p: Column) -> Column:
    return -p * F.log2(p)


def level_shares(lev: DataFrame) -> DataFrame:
    """One row a window: counts of its levels."""
    per = lev.groupBy(*KEYS, "lev").agg(F.count("*").alias("m"), F.max("n_values").alias("n_values"))
    return per.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("m")).alias("ms"), F.sum("m").alias("n"), F.max("lev").alias("hi"), F.min("lev").alias("lo"), F.max("n_values").alias("n_values"), F.count("*").alias("q")
    )


def level_engines(lev: DataFrame, bins: int = 10) -> DataFrame:
    """level_count, level_histogram and duty_cycle: all from the counts of levels."""
    s = level_shares(lev)
    n, q = F.col("n").cast("double"), F.col("q")
    total = F.when(F.col("n_values") > bins, F.lit(bins)).otherwise(F.col("n_values"))
    h = A.total(F.transform("ms", lambda m: _plogp(m / n)))
    top = F.try_element_at("ms", F.lit(-1)) / n
    second = F.coalesce(F.try_element_at("ms", F.lit(-2)) / n, F.lit(0.0))
    limit = F.when(q > 1, F.log2(q.cast("double"))).otherwise(1.0)
    cumulative = A.total(A.running(F.transform("ms", lambda m: m / n)))
    gini = F.when(q > 1, 1 - 2 * cumulative / q + 1.0 / q).otherwise(0.0)
    tail = A.total(F.transform(F.slice("ms", 1, F.greatest(F.lit(1), F.floor(q * 0.2).cast("int"))), lambda m: m.cast("double"))) / n
    return s.select(
        *KEYS, q.alias("n_levels"), (q / F.greatest(total, F.lit(1))).alias("level_occupancy"), top.alias("dominant_level"),
        F.when(q > 1, (F.col("hi") - F.col("lo")) / F.greatest(total - 1, F.lit(1))).otherwise(0.0).cast("double").alias("level_spread"), h.alias("level_entropy"),
        (1 - F.least(F.greatest(limit - h, F.lit(0.0)) / limit, F.lit(1.0))).alias("hist_uniformity"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini)).alias("hist_concentration"), F.when(second > 0, top / second).alias("hist_peak_ratio"), tail.alias("hist_tail_weight"),
        second.alias("duty_secondary"), F.when(q > 1, h / limit).otherwise(0.0).alias("duty_balance"),
        (top - F.try_element_at("ms", F.lit(1)) / n).alias("duty_range"),
    )


def transition_matrix(lev: DataFrame) -> DataFrame:
    """Summaries of the level-to-level Markov matrix."""
    inside = Window.partitionBy(*KEYS)
    nxt = lev.withColumn("b", F.lead("lev").over(inside.orderBy("i"))).withColumn("a", F.col("lev"))
    kinds = lev.groupBy(*KEYS).agg(F.count_distinct("lev").alias("q"))
    t = nxt.filter("b is not null").groupBy(*KEYS, "a", "b").agg(F.count("*").alias("m"))
    t = t.withColumn("row", F.sum("m").over(Window.partitionBy(*KEYS, "a"))).withColumn("p", F.col("m") / F.col("row"))
    back = t.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b"), F.col("p").alias("pt"))
    # T - T' has an entry wherever T or T' has one; |T - T'|^2 = 2 |T|^2 - 2 sum T T'
    both = t.join(back, [*KEYS, "a", "b"], "left")
    per = both.groupBy(*KEYS).agg(
        F.sum(F.col("p") * F.col("p")).alias("t2"), F.sum(F.col("p") * F.coalesce("pt", F.lit(0.0))).alias("tt"), F.count("*").alias("active"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("p"))).alias("diag"), F.max(F.when(F.col("a") == F.col("b"), F.col("p"))).alias("top"),
        F.sum(_plogp(F.col("p"))).alias("h"), F.count_distinct("a").alias("rows"), F.sum("m").alias("moves"), F.sum("m").alias("n_moves"),
        F.sum(F.when(F.col("a") != F.col("b"), F.col("m")).otherwise(0)).alias("changes"),
    )
    j = kinds.join(per, list(KEYS), "left")
    q = F.col("q")
    one = q < 2
    return j.select(
        *KEYS, F.when(one, 0.0).otherwise(F.col("h") / F.col("rows")).alias("trans_entropy"), F.when(one, 1.0).otherwise(F.coalesce("diag", F.lit(0.0)) / q).alias("trans_self_loop"),
        F.when(one, 1.0).otherwise(F.coalesce("top", F.lit(0.0))).alias("trans_max_self_loop"),
        F.when(one, 0.0).otherwise(F.sqrt(F.greatest(2 * F.col("t2") - 2 * F.col("tt"), F.lit(0.0)) / F.col("t2"))).alias("trans_asymmetry"),
        F.when(one, F.lit(0)).otherwise(F.col("active")).cast("long").alias("trans_n_active"), F.when(one, 1.0).otherwise(1 - F.col("active") / (q * q)).alias("trans_sparsity"),
        F.coalesce("changes", F.lit(0)).cast("long").alias("transition_count"),
    )


def raw_entropy(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Base-2 Shannon entropy of raw values, normalised, and conditional on the value before."""
    inside = Window.partitionBy(*KEYS)
    per = rows.groupBy(*KEYS, "value").agg(F.count("*").alias("m"))
    per = per.withColumn("n", F.sum("m").over(inside))
    h = per.groupBy(*KEYS).agg(F.sum(_plogp(F.col("m") / F.col("n"))).alias("h"), F.count("*").alias("q"))
    t = rows.withColumn("b", F.lead("value").over(inside.orderBy("i"))).filter("b is not null").groupBy(*KEYS, "value", "b").agg(F.count("*").alias("m"))
    t = t.withColumn("row", F.sum("m").over(Window.partitionBy(*KEYS, "value"))).withColumn("all", F.sum("m").over(inside))
    c = t.groupBy(*KEYS).agg(F.sum(F.col("m") / F.col("all") * -F.log2(F.col("m") / F.col("row"))).alias("c"))
    limit = F.when(F.least("q", F.lit(bins)) > 1, F.log2(F.least("q", F.lit(bins)).cast("double"))).otherwise(1.0)
    j = h.join(c, list(KEYS), "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    return j.select(
        *KEYS, F.col("h").alias("shannon_entropy"), (F.col("h") / limit).alias("normalized_entropy"), F.col("c").alias("conditional_entropy"), F.col("c").alias("entropy_rate"), (F.col("h") - F.col("c")).alias("excess_entropy")
    )


def _runs(rows: DataFrame, what: str) -> DataFrame:
    r = W.runs(rows, F.col(what), KEYS, "i")
    return r.groupBy(*KEYS, "run").agg(F.count("*").cast("double").alias("len"), F.first(what).alias("state"))


def dwell_times(rows: DataFrame) -> DataFrame:
    """Lengths of runs of equal raw values."""
    r = _runs(rows, "value")
    m, sd = F.avg("len"), F.stddev_pop("len")
    return r.groupBy(*KEYS).agg(m.alias("dwell_mean"), sd.alias("dwell_std"), F.max("len").alias("dwell_max"), F.min("len").alias("dwell_min"), (sd / m).alias("dwell_cv"), F.count("*").alias("n_dwells"))


def mean_time_between(lev: DataFrame) -> DataFrame:
    """Mean run length of each level, then over levels."""
    s = _runs(lev, "lev").groupBy(*KEYS, "state").agg(F.avg("len").alias("len"))
    m, sd = F.avg("len"), F.stddev_pop("len")
    return s.groupBy(*KEYS).agg(m.alias("mtb_mean"), sd.alias("mtb_std"), F.max("len").alias("mtb_max"), F.min("len").alias("mtb_min"), (sd / m).alias("mtb_cv"))


def permutation_entropy(rows: DataFrame) -> DataFrame:
    """Entropy of order patterns of three neighbours over log2 6; ties keep their order. rows: indexed by i in a window."""
    order = Window.partitionBy(*KEYS).orderBy("i")
    a, b, c = F.col("value"), F.lead("value", 1).over(order), F.lead("value", 2).over(order)
    code = (b < a).cast("int") * 4 + (c < a).cast("int") * 2 + (c < b).cast("int")
    p = rows.withColumn("code", F.when(c.isNotNull(), code)).filter("code is not null").groupBy(*KEYS, "code").agg(F.count("*").alias("m"))
    p = p.withColumn("n", F.sum("m").over(Window.partitionBy(*KEYS)))
    return p.groupBy(*KEYS).agg((F.sum(_plogp(F.col("m") / F.col("n"))) / F.log2(F.lit(6.0))).alias("permutation_entropy"))


def sample_entropy(windows: DataFrame, m: int = 2, r: float = 0.2) -> DataFrame:
    """-ln(A / B) over pairs of templates within r deviations (Chebyshev), self matches left out."""
    x, n = F.col("x"), F.size("x")
    w = windows.withColumn("tol", F.lit(r) * F.sqrt(A.moments(x, A.mean(x), 2)))
    near = lambda i, j, k: F.abs(F.get(x, i + k) - F.get(x, j + k)) <= F.col("tol")

    def matches(length: int):
        both = lambda i, j: near(i, j, 0) if length == 1 else near(i, j, 0) & near(i, j, 1) if length == 2 else near(i, j, 0) & near(i, j, 1) & near(i, j, 2)
        return F.aggregate(
            F.sequence(F.lit(0), n - m - 1), F.lit(0).cast("long"),
            lambda a, i: a + F.size(F.filter(F.sequence(F.lit(0), n - m - 1), lambda j: (j > i) & both(i, j))).cast("long"),
        )

    w = w.filter(n > m + 1).withColumn("b", matches(m)).withColumn("a", matches(m + 1))
    return w.select(*KEYS, F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.col("a") / F.col("b"))).alias("sample_entropy"))


def spectral(windows: DataFrame) -> DataFrame:
    """Periodogram of the centred window by explicit sums: dominant frequency, entropy (over log2 of the bins),
    centroid, bandwidth, flatness. Right for short windows; long ones go to the numeric kernels."""
    x, n = F.col("x"), F.size("x")
    w = windows.withColumn("m", A.mean(x)).withColumn("v", A.moments(x, A.mean(x), 2))
    two_pi = 6.283185307179586

    def power(k):
        re = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0).cast("double"), lambda a, i: a + (F.get(x, i) - F.col("m")) * F.cos(two_pi * k * i / n))
        im = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0).cast("double"), lambda a, i: a + (F.get(x, i) - F.col("m")) * F.sin(two_pi * k * i / n))
        return F.struct((k.cast("double") / n).alias("f"), ((re * re + im * im) / n).alias("p"))

    w = w.withColumn("ps", F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), power))
    total = A.total(F.transform("ps", lambda s: s["p"]))
    w = w.withColumn("t", F.nullif(total, F.lit(0.0)))
    w = w.withColumn("centroid", A.total(F.transform("ps", lambda s: s["f"] * s["p"])) / F.col("t"))
    bins = F.size("ps").cast("double")
    h = A.total(F.transform("ps", lambda s: F.when(s["p"] > 0, -(s["p"] / F.col("t")) * F.log2(s["p"] / F.col("t"))).otherwise(0.0)))
    band = F.sqrt(A.total(F.transform("ps", lambda s: (s["f"] - F.col("centroid")) * (s["f"] - F.col("centroid")) * s["p"])) / F.col("t"))
    flatness = F.exp(A.mean(F.transform("ps", lambda s: F.ln(s["p"])))) / (F.col("t") / bins)
    top = F.array_max(F.transform("ps", lambda s: F.struct(s["p"].alias("p"), (-s["f"]).alias("f"))))
    still = F.col("v") < 1e-20
    return w.select(
        *KEYS, F.when(still, 0.0).otherwise(-top["f"]).alias("dominant_freq"), F.when(still, 0.0).otherwise(h / F.log2(bins)).alias("spectral_entropy"),
        F.when(still, 0.0).otherwise(F.col("centroid")).alias("spectral_centroid"), F.when(still, 0.0).otherwise(band).alias("spectral_bandwidth"), F.when(still, 0.0).otherwise(flatness).alias("spectral_flatness"),
    )
