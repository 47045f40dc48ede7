"""Windows, engines and typology over the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import engines as E
from ..operators import typology as T
from ..sources import observations as O
from . import sql as S
from .catalog import query, rounded

WIN, STEP = 32, 16


def hopped(spark, sf, window=WIN, stride=STEP, lags=(), look=None):
    return W.hop(E.lagged(O.obs_events(spark, sf), *lags), window, stride, look)


def arrays(spark, sf, window=WIN, stride=STEP):
    return W.window_arrays(hopped(spark, sf, window, stride))


H = S.hops(WIN, STEP)
G = "GROUP BY cohort, signal_id, k"


def agg(select: str, columns: list[str], pre: str = H, src: str = "c", digits: int = 6) -> str:
    return S.rounded(f"{pre}, q AS (SELECT cohort, signal_id, k, {select} FROM {src} {G})", columns, digits=digits)


@query("hop_windows", S.hops(20, 7, 30) + " SELECT cohort, signal_id, k, count(*) AS n_obs, min(signal_0) AS signal_0_start, max(signal_0) AS signal_0_end, round(avg(value), 6) AS mean FROM w GROUP BY ALL")
def hop_windows(spark, sf):
    """Windows of 20 every 7 rows with a look-back of 30."""
    return hopped(spark, sf, 20, 7, look=30).groupBy("cohort", "signal_id", "k").agg(
        F.count("*").alias("n_obs"), F.min("signal_0").alias("signal_0_start"), F.max("signal_0").alias("signal_0_end"), F.round(F.avg("value"), 6).alias("mean")
    )


@query("hop_windows_short", S.indexed() + """, v AS (SELECT *, least(300, n) AS wl FROM r), g AS (SELECT cohort, signal_id, wl, unnest(range(0, (n - wl) // 50 + 1)) AS k FROM (SELECT DISTINCT cohort, signal_id, n, wl FROM v))
SELECT v.cohort, v.signal_id, g.k, count(*) AS n_obs, round(avg(v.value), 6) AS mean FROM g JOIN v ON v.cohort = g.cohort AND v.signal_id = g.signal_id AND v.r BETWEEN g.k * 50 AND g.wl - 1 + g.k * 50 GROUP BY ALL""")
def hop_windows_short(spark, sf):
    """A series shorter than the window gives one window over all of it."""
    rows = W.hop(W.indexed(O.obs_events(spark, sf)), 300, 50, short="one")
    return rows.groupBy("cohort", "signal_id", "k").agg(F.count("*").alias("n_obs"), F.round(F.avg("value"), 6).alias("mean"))


@query("rolling_statistics", S.indexed() + """ SELECT cohort, signal_id, signal_0, CASE WHEN r >= 15 THEN round(m, 6) END AS roll_mean, CASE WHEN r >= 15 THEN round(s, 6) END AS roll_std, CASE WHEN r >= 15 THEN round(hi - lo, 6) END AS roll_range, CASE WHEN r >= 15 THEN round(b, 6) END AS roll_slope
FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, max(value) OVER w AS hi, min(value) OVER w AS lo, regr_slope(value, r) OVER w AS b FROM r WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))""")
def rolling_statistics(spark, sf):
    """Stride-1 rolling windows as row frames; NULL until the window is full."""
    w = W.rolling(16)
    full = lambda c: F.round(F.when(F.col("r") >= 15, c), 6)
    return W.indexed(O.obs_events(spark, sf)).select(
        "cohort", "signal_id", "signal_0", full(F.avg("value").over(w)).alias("roll_mean"), full(F.stddev_samp("value").over(w)).alias("roll_std"),
        full(F.max("value").over(w) - F.min("value").over(w)).alias("roll_range"), full(F.regr_slope("value", "r").over(w)).alias("roll_slope"),
    )


_M = "sqrt(avg(d * d))"


@query("eng_statistics", agg("avg(d ** 4) / nullif(avg(d * d) ** 2, 0) - 3 AS kurtosis, avg(d ** 3) / nullif(avg(d * d) ** 1.5, 0) AS skewness, max(abs(value)) / nullif(sqrt(avg(value * value)), 0) AS crest_factor", ["kurtosis", "skewness", "crest_factor"]))
def eng_statistics(spark, sf):
    return rounded(E.statistics(hopped(spark, sf)))


@query("eng_peak_rms", agg("max(abs(value)) AS peak, max(value) - min(value) AS peak_to_peak, sqrt(avg(value * value)) AS rms", ["peak", "peak_to_peak", "rms"]))
def eng_peak_rms(spark, sf):
    return rounded(E.peak_rms(hopped(spark, sf)))


@query("eng_trend", S.rounded(H + f", c2 AS (SELECT *, sum(d) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS cs FROM c), q AS (SELECT cohort, signal_id, k, regr_slope(value, i) AS trend_slope, regr_r2(value, i) AS trend_r2, sqrt(var_pop(value) * (1 - regr_r2(value, i))) AS detrend_std, max(cs) - min(cs) AS cusum_range FROM c2 {G})", ["trend_slope", "trend_r2", "detrend_std", "cusum_range"], digits=7))
def eng_trend(spark, sf):
    return rounded(E.trend(hopped(spark, sf)), digits=7)


@query("eng_rate_of_change", agg("avg(value - p) AS mean_rate, max(value - p) AS max_rate, min(value - p) AS min_rate, stddev_pop(value - p) AS rate_std, max(abs(value - p)) AS abs_max_rate, avg(value - p) / stddev_pop(value) AS mean_roc, stddev_pop(value - p) / stddev_pop(value) AS std_roc, max(abs(value - p)) / stddev_pop(value) AS max_roc", ["mean_rate", "max_rate", "min_rate", "rate_std", "abs_max_rate", "mean_roc", "std_roc", "max_roc"]))
def eng_rate_of_change(spark, sf):
    return rounded(E.rate_of_change(hopped(spark, sf, lags=(1,))))


@query("eng_variance_ratio", S.rounded(H + f", l AS (SELECT *, value - lag(value, 2) OVER z AS d2, value - lag(value, 4) OVER z AS d4, value - lag(value, 8) OVER z AS d8 FROM c WINDOW z AS (PARTITION BY cohort, signal_id, k ORDER BY i)), q AS (SELECT cohort, signal_id, k, var_samp(d2) / (2 * var_samp(value - p)) AS variance_ratio, var_samp(d4) / (4 * var_samp(value - p)) AS variance_ratio_4, var_samp(d8) / (8 * var_samp(value - p)) AS variance_ratio_8, (var_samp(d2) / (2 * var_samp(value - p)) - 1) / sqrt(2.0 / (count(*) - 1)) AS variance_ratio_stat FROM l {G})", ["variance_ratio", "variance_ratio_4", "variance_ratio_8", "variance_ratio_stat"]))
def eng_variance_ratio(spark, sf):
    return rounded(E.variance_ratio(hopped(spark, sf, lags=(1, 2, 4, 8))))


@query("eng_acf_decay", S.rounded(H + """, a AS (SELECT x.cohort, x.signal_id, x.k, l.lag, sum(x.d * y.d) AS s FROM c x JOIN c y USING (cohort, signal_id, k) JOIN (SELECT unnest(range(0, 17)) AS lag) l ON y.i = x.i + l.lag GROUP BY ALL),
b AS (SELECT a.cohort, a.signal_id, a.k, a.lag, a.s / z.s AS f FROM a JOIN a z ON z.cohort = a.cohort AND z.signal_id = a.signal_id AND z.k = a.k AND z.lag = 0),
q AS (SELECT cohort, signal_id, k, max(f) FILTER (lag = 1) AS acf_lag1, max(f) FILTER (lag = 10) AS acf_lag10, min(lag) FILTER (lag > 0 AND f < 0.5) AS acf_half_life FROM b GROUP BY cohort, signal_id, k)""", ["acf_lag1", "acf_lag10", "acf_half_life"]))
def eng_acf_decay(spark, sf):
    return rounded(E.acf_decay(arrays(spark, sf)))


@query("eng_variance_growth", S.rounded(H + """, s AS (SELECT *, sum(value) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS cs FROM c),
v AS (SELECT cohort, signal_id, k, kk, var_pop(cs) AS v FROM s JOIN (SELECT unnest([4, 8, 16, 32]) AS kk) ON i < kk GROUP BY ALL),
q AS (SELECT cohort, signal_id, k, regr_slope(ln(v), ln(kk)) AS variance_growth_rate, max(v) FILTER (kk = 32) / max(v) FILTER (kk = 16) / 2 AS variance_ratio FROM v GROUP BY cohort, signal_id, k)""", ["variance_growth_rate", "variance_ratio"]))
def eng_variance_growth(spark, sf):
    return rounded(E.variance_growth(arrays(spark, sf)))


@query("eng_pulsation", agg("(max(value) - min(value)) / (abs(avg(value)) + 1e-10) AS pulsation_index, avg(value) AS flow_mean, max(value) - min(value) AS flow_range", ["pulsation_index", "flow_mean", "flow_range"], digits=7))
def eng_pulsation(spark, sf):
    return rounded(E.pulsation(hopped(spark, sf)), digits=7)


@query("eng_time_constant", S.rounded(S.hops(10, 3) + f""", y AS (SELECT *, ln(value - min(value) OVER (PARTITION BY cohort, signal_id, k) + 1e-10) AS ly FROM c),
z AS (SELECT cohort, signal_id, k, count(*) FILTER (value > p) AS up, count(*) FILTER (value < p) AS down, regr_slope(ly, i) AS s, regr_r2(ly, i) AS r2, avg(value) FILTER (i < 1) AS head, avg(value) FILTER (i >= 9) AS tail FROM y {G}),
q AS (SELECT cohort, signal_id, k, CASE WHEN ok THEN abs(1 / s) END AS time_constant, CASE WHEN ok THEN tail END AS equilibrium_value, CASE WHEN ok THEN r2 END AS fit_r2, CASE WHEN ok THEN (head > tail)::INT END AS is_decay FROM (SELECT *, greatest(up, down) >= 0.7 * (up + down) AND up + down >= 2 AND abs(s) >= 1e-15 AS ok FROM z))""", ["time_constant", "equilibrium_value", "fit_r2", "is_decay"]))
def eng_time_constant(spark, sf):
    return rounded(E.time_constant(hopped(spark, sf, 10, 3, lags=(1,))))


@query("eng_basin", S.rounded(S.hops(128, 64) + f""", b AS (SELECT *, coalesce(least(floor((value - min(value) OVER z) / nullif((max(value) OVER z - min(value) OVER z) / 20, 0)), 19), 0) AS bin FROM c WINDOW z AS (PARTITION BY cohort, signal_id, k)),
l AS (SELECT *, lag(bin) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS pb FROM b), e AS (SELECT cohort, signal_id, k, bin, count(*) AS cnt, count(*) FILTER (bin <> pb) AS moved FROM l GROUP BY ALL),
q AS (SELECT cohort, signal_id, k, max(cnt) / sum(cnt) AS basin_stability, sum(moved) / (sum(cnt) - 1) AS transition_prob, count(*) FILTER (cnt > 128 / 20.0 * 0.5) AS n_attractors FROM e {G})""", ["basin_stability", "transition_prob", "n_attractors"]))
def eng_basin(spark, sf):
    return rounded(E.basin(hopped(spark, sf, 128, 64)))


@query("eng_mann_kendall", S.rounded(H + """, pr AS (SELECT cohort, signal_id, k, sum(sign(y.value - x.value)) AS s, median((y.value - x.value) / (y.i - x.i)) AS b FROM c x JOIN c y USING (cohort, signal_id, k) WHERE y.i > x.i GROUP BY ALL),
q AS (SELECT cohort, signal_id, k, CASE WHEN s > 0 THEN (s - 1) / sqrt(32 * 31 * 69 / 18.0) WHEN s < 0 THEN (s + 1) / sqrt(32 * 31 * 69 / 18.0) ELSE 0 END AS mk_stat, b AS mk_slope FROM pr)""", ["mk_stat", "mk_slope"]))
def eng_mann_kendall(spark, sf):
    return rounded(E.mann_kendall(arrays(spark, sf)))


@query("eng_cycle_counting", S.rounded(H + f""", t AS (SELECT *, lead(value) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS nx FROM c), tp AS (SELECT * FROM t WHERE p IS NULL OR nx IS NULL OR (value - p) * (nx - value) < 0),
rg AS (SELECT cohort, signal_id, k, abs(lead(value) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) - value) AS rg FROM tp), mx AS (SELECT *, max(rg) OVER (PARTITION BY cohort, signal_id, k) AS mr FROM rg WHERE rg IS NOT NULL),
q AS (SELECT cohort, signal_id, k, count(*) // 2 + count(*) % 2 AS n_cycles, count(*) // 2 AS n_full_cycles, count(*) % 2 AS n_half_cycles, max(rg) AS max_range, avg(rg) AS mean_range, sum((rg / mr) ** 3) * 0.5 AS cycle_accumulation FROM mx {G})""", ["n_cycles", "n_full_cycles", "n_half_cycles", "max_range", "mean_range", "cycle_accumulation"]))
def eng_cycle_counting(spark, sf):
    return rounded(E.cycle_counting(arrays(spark, sf)))


LV = S.levels(WIN, STEP)


@query("eng_levels", S.rounded(LV + """, e AS (SELECT cohort, signal_id, k, lev, count(*) AS cnt, max(nv) AS nv FROM lv GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id, k ORDER BY cnt DESC, lev) AS dn, row_number() OVER (PARTITION BY cohort, signal_id, k ORDER BY cnt, lev) AS up, count(*) OVER (PARTITION BY cohort, signal_id, k) AS kq FROM e),
cu AS (SELECT *, sum(cnt / 32.0) OVER (PARTITION BY cohort, signal_id, k ORDER BY up) AS cum FROM o),
f AS (SELECT cohort, signal_id, k, max(kq) AS kq, least(max(nv), 10) AS tot, max(cnt) / 32.0 AS top, coalesce(max(cnt) FILTER (dn = 2), 0) / 32.0 AS second, min(cnt) / 32.0 AS low, max(lev) - min(lev) AS sp, sum(-(cnt / 32.0) * log2(cnt / 32.0)) AS h, sum(cum) AS scum, sum(cnt) FILTER (up <= greatest(1, floor(kq * 0.2))) / 32.0 AS tail FROM cu GROUP BY cohort, signal_id, k),
q AS (SELECT cohort, signal_id, k, kq AS n_levels, kq / tot AS level_occupancy, top AS dominant_level, CASE WHEN kq > 1 THEN sp / greatest(tot - 1, 1) ELSE 0 END AS level_spread, h AS level_entropy, 1 - least(greatest(log2(kq) - h, 0) / log2(kq), 1) AS hist_uniformity, greatest(0, least(1, 1 - 2 * scum / kq + 1.0 / kq)) AS hist_concentration, CASE WHEN second > 0 THEN top / second END AS hist_peak_ratio, tail AS hist_tail_weight, second AS duty_secondary, h / log2(kq) AS duty_balance, top - low AS duty_range FROM f)""",
    ["n_levels", "level_occupancy", "dominant_level", "level_spread", "level_entropy", "hist_uniformity", "hist_concentration", "hist_peak_ratio", "hist_tail_weight", "duty_secondary", "duty_balance", "duty_range"]))
def eng_levels(spark, sf):
    """level_count, level_histogram and duty_cycle together."""
    return rounded(E.level_engines(E.levels(hopped(spark, sf))))


@query("eng_transition_matrix", S.rounded(LV + """, nx AS (SELECT cohort, signal_id, k, lev AS a, lead(lev) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS b FROM lv), t AS (SELECT cohort, signal_id, k, a, b, count(*) AS m FROM nx WHERE b IS NOT NULL GROUP BY ALL),
p AS (SELECT *, m / sum(m) OVER (PARTITION BY cohort, signal_id, k, a) AS pr FROM t), kq AS (SELECT cohort, signal_id, k, count(DISTINCT lev) AS kq FROM lv GROUP BY ALL),
df AS (SELECT coalesce(x.cohort, y.cohort) AS cohort, coalesce(x.signal_id, y.signal_id) AS signal_id, coalesce(x.k, y.k) AS k, sum((coalesce(x.pr, 0) - coalesce(y.pr, 0)) ** 2) AS dd FROM p x FULL JOIN p y ON x.cohort = y.cohort AND x.signal_id = y.signal_id AND x.k = y.k AND x.a = y.b AND x.b = y.a GROUP BY ALL),
rh AS (SELECT cohort, signal_id, k, a, sum(-pr * log2(pr)) AS h FROM p GROUP BY ALL), rm AS (SELECT cohort, signal_id, k, avg(h) AS h FROM rh GROUP BY ALL),
s AS (SELECT cohort, signal_id, k, sum(pr * pr) AS t2, count(*) AS act, coalesce(sum(pr) FILTER (a = b), 0) AS dg, coalesce(max(pr) FILTER (a = b), 0) AS tp, coalesce(sum(m) FILTER (a <> b), 0) AS ch FROM p GROUP BY ALL),
q AS (SELECT cohort, signal_id, k, rm.h AS trans_entropy, dg / kq AS trans_self_loop, tp AS trans_max_self_loop, sqrt(dd / t2) AS trans_asymmetry, act AS trans_n_active, 1 - act / (kq * kq) AS trans_sparsity, ch AS transition_count FROM s JOIN kq USING (cohort, signal_id, k) JOIN df USING (cohort, signal_id, k) JOIN rm USING (cohort, signal_id, k))""",
    ["trans_entropy", "trans_self_loop", "trans_max_self_loop", "trans_asymmetry", "trans_n_active", "trans_sparsity", "transition_count"]))
def eng_transition_matrix(spark, sf):
    return rounded(E.transition_matrix(E.levels(hopped(spark, sf))))


Q5 = S.hops(WIN, STEP).replace("value FROM events)", "round(value / 100) AS value FROM events)")


def coarse(spark, sf):
    """Events in steps of 100, for engines of raw discrete values."""
    obs = O.obs_events(spark, sf).withColumn("value", F.round(F.col("value") / 100))
    return W.hop(E.lagged(obs, 1), WIN, STEP)


@query("eng_entropy", S.rounded(Q5 + """, e AS (SELECT cohort, signal_id, k, value, count(*) / 32.0 AS f FROM w GROUP BY ALL), h AS (SELECT cohort, signal_id, k, sum(-f * log2(f)) AS h, count(*) AS kq FROM e GROUP BY ALL),
nx AS (SELECT cohort, signal_id, k, value AS a, lead(value) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS b FROM w), t AS (SELECT cohort, signal_id, k, a, b, count(*) AS m FROM nx WHERE b IS NOT NULL GROUP BY ALL),
t2 AS (SELECT *, m / sum(m) OVER (PARTITION BY cohort, signal_id, k, a) AS pr FROM t), cn AS (SELECT cohort, signal_id, k, sum(m / 31.0 * -log2(pr)) AS cnd FROM t2 GROUP BY ALL),
q AS (SELECT cohort, signal_id, k, h AS shannon_entropy, h / CASE WHEN least(kq, 10) > 1 THEN log2(least(kq, 10)) ELSE 1 END AS normalized_entropy, cnd AS conditional_entropy, cnd AS entropy_rate, h - cnd AS excess_entropy FROM h JOIN cn USING (cohort, signal_id, k))""",
    ["shannon_entropy", "normalized_entropy", "conditional_entropy", "entropy_rate", "excess_entropy"]))
def eng_entropy(spark, sf):
    return rounded(E.raw_entropy(coarse(spark, sf)))


_RUNS = ", ch AS (SELECT *, CASE WHEN {x} = lag({x}) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) THEN 0 ELSE 1 END AS nw FROM {src}), ru AS (SELECT *, sum(nw) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS run FROM ch), ln AS (SELECT cohort, signal_id, k, run, any_value({x}) AS state, count(*)::DOUBLE AS len FROM ru GROUP BY cohort, signal_id, k, run)"


@query("eng_dwell_times", S.rounded(Q5 + _RUNS.format(x="value", src="w") + f", q AS (SELECT cohort, signal_id, k, avg(len) AS dwell_mean, stddev_pop(len) AS dwell_std, max(len) AS dwell_max, min(len) AS dwell_min, stddev_pop(len) / avg(len) AS dwell_cv, count(*) AS n_dwells FROM ln {G})", ["dwell_mean", "dwell_std", "dwell_max", "dwell_min", "dwell_cv", "n_dwells"]))
def eng_dwell_times(spark, sf):
    return rounded(E.dwell_times(coarse(spark, sf)))


@query("eng_mean_time_between", S.rounded(LV + _RUNS.format(x="lev", src="lv") + f", st AS (SELECT cohort, signal_id, k, state, avg(len) AS len FROM ln GROUP BY ALL), q AS (SELECT cohort, signal_id, k, avg(len) AS mtb_mean, stddev_pop(len) AS mtb_std, max(len) AS mtb_max, min(len) AS mtb_min, stddev_pop(len) / avg(len) AS mtb_cv FROM st {G})", ["mtb_mean", "mtb_std", "mtb_max", "mtb_min", "mtb_cv"]))
def eng_mean_time_between(spark, sf):
    return rounded(E.mean_time_between(E.levels(hopped(spark, sf))))


_PERM = ", pz AS (SELECT *, lead(value) OVER z AS b, lead(value, 2) OVER z AS e FROM w WINDOW z AS (PARTITION BY cohort, signal_id, k ORDER BY i)), pc AS (SELECT cohort, signal_id, k, (b < value)::INT * 4 + (e < value)::INT * 2 + (e < b)::INT AS code, count(*) AS m FROM pz WHERE e IS NOT NULL GROUP BY ALL), pp AS (SELECT *, m / sum(m) OVER (PARTITION BY cohort, signal_id, k) AS pr FROM pc)"


@query("eng_permutation_entropy", S.rounded(H + _PERM + f", q AS (SELECT cohort, signal_id, k, sum(-pr * log2(pr)) / log2(6) AS permutation_entropy FROM pp {G})", ["permutation_entropy"]))
def eng_permutation_entropy(spark, sf):
    return rounded(E.permutation_entropy(hopped(spark, sf)))


@query("eng_sample_entropy", S.rounded(H + """, tl AS (SELECT *, 0.2 * stddev_pop(value) OVER (PARTITION BY cohort, signal_id, k) AS tol, lead(value) OVER z AS v1, lead(value, 2) OVER z AS v2 FROM w WINDOW z AS (PARTITION BY cohort, signal_id, k ORDER BY i)),
ab AS (SELECT cohort, signal_id, k, count(*) FILTER (abs(x.value - y.value) <= x.tol AND abs(x.v1 - y.v1) <= x.tol) AS b, count(*) FILTER (abs(x.value - y.value) <= x.tol AND abs(x.v1 - y.v1) <= x.tol AND abs(x.v2 - y.v2) <= x.tol) AS a FROM tl x JOIN tl y USING (cohort, signal_id, k) WHERE y.i > x.i AND x.i < 30 AND y.i < 30 GROUP BY ALL),
q AS (SELECT cohort, signal_id, k, CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END AS sample_entropy FROM ab)""", ["sample_entropy"]))
def eng_sample_entropy(spark, sf):
    return rounded(E.sample_entropy(arrays(spark, sf)))


_DFT = """, ft AS (SELECT cohort, signal_id, k, f, sum(d * cos(2 * pi() * f * i / 32)) AS re, sum(d * sin(2 * pi() * f * i / 32)) AS im FROM c JOIN (SELECT unnest(range(1, 17)) AS f) ON true GROUP BY ALL),
ps AS (SELECT cohort, signal_id, k, f / 32.0 AS fr, (re * re + im * im) / 32 AS p, sum((re * re + im * im) / 32) OVER (PARTITION BY cohort, signal_id, k) AS t FROM ft),
ce AS (SELECT *, sum(fr * p / t) OVER (PARTITION BY cohort, signal_id, k) AS cen FROM ps)"""


@query("spectral_dft", S.rounded(H + _DFT + f", q AS (SELECT cohort, signal_id, k, arg_max(fr, p) AS dominant_freq, sum(-p / t * log2(p / t)) / log2(16) AS spectral_entropy, max(cen) AS spectral_centroid, sqrt(sum((fr - cen) ** 2 * p / t)) AS spectral_bandwidth, exp(avg(ln(p))) / avg(p) AS spectral_flatness FROM ce {G})", ["dominant_freq", "spectral_entropy", "spectral_centroid", "spectral_bandwidth", "spectral_flatness"]))
def spectral_dft(spark, sf):
    return rounded(E.spectral(arrays(spark, sf)))


_TYP = H + f""", zc AS (SELECT *, sign(d) <> sign(lag(d) OVER (PARTITION BY cohort, signal_id, k ORDER BY i)) AS crossed FROM c),
ty AS (SELECT cohort, signal_id, k, avg(d ** 4) / avg(d * d) ** 2 - 3 AS kurtosis, CASE WHEN abs(avg(value)) < 1e-10 THEN stddev_samp(value) ELSE stddev_samp(value) / abs(avg(value)) END AS cv, CASE WHEN stddev_samp(value) < 1e-10 THEN 0 ELSE (max(value) - min(value)) / stddev_samp(value) END AS range_norm, count(*) FILTER (crossed) / (count(*) - 1) AS zero_crossing_rate, regr_r2(value, i) AS trend_strength, avg(abs(value - p)) AS mean_abs_diff FROM zc {G})"""


@query("typology_windows", S.rounded(_TYP + _PERM + f", pe AS (SELECT cohort, signal_id, k, sum(-pr * log2(pr)) / log2(6) AS perm_entropy FROM pp {G}), q AS (SELECT * FROM ty JOIN pe USING (cohort, signal_id, k))", ["kurtosis", "cv", "range_norm", "zero_crossing_rate", "trend_strength", "mean_abs_diff", "perm_entropy"]))
def typology_windows(spark, sf):
    return rounded(T.window_metrics(hopped(spark, sf, lags=(1,))))


@query("typology_vector", _TYP + """ SELECT cohort, signal_id, count(*) AS n_windows, round(avg(cv), 6) AS cv_mean, round(stddev_samp(cv), 6) AS cv_std, round(stddev_samp(cv) / nullif(abs(avg(cv)), 0), 6) AS cv_cv, stddev_samp(cv) / nullif(abs(avg(cv)), 0) > 0.1 AS cv_varies,
round(avg(trend_strength), 6) AS trend_strength_mean, round(stddev_samp(trend_strength), 6) AS trend_strength_std, round(stddev_samp(trend_strength) / nullif(abs(avg(trend_strength)), 0), 6) AS trend_strength_cv, stddev_samp(trend_strength) / nullif(abs(avg(trend_strength)), 0) > 0.1 AS trend_strength_varies FROM ty GROUP BY cohort, signal_id""")
def typology_vector(spark, sf):
    v = T.vector(T.window_metrics(hopped(spark, sf, lags=(1,))), ["cv", "trend_strength"])
    return v.select("cohort", "signal_id", "n_windows", *(c if c.endswith("varies") else F.round(c, 6).alias(c) for c in v.columns[3:]))


@query("engine_gates", _TYP + " SELECT cohort, signal_id, k, 1 + CASE WHEN trend_strength > 0.05 THEN 2 ELSE 0 END + CASE WHEN cv >= 0.55 THEN 4 ELSE 0 END AS engine_mask FROM ty")
def engine_gates(spark, sf):
    """Which engines may run in a window: bit 0 statistics, 1 trend (unless trend is weak), 2 levels (unless cv is low)."""
    gates = {"statistics": {}, "trend": {"trend_strength": {"gt_skip": None, "lt_skip": 0.05}}, "levels": {"cv": {"lt_skip": 0.55}}}
    return T.gated(T.window_metrics(hopped(spark, sf, lags=(1,))), gates).select("cohort", "signal_id", "k", F.col("engine_mask").cast("int").alias("engine_mask"))
