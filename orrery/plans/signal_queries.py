"""Summaries, normalisation and breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breaks as B
from ..operators import engines as E
from ..operators import kernel_ops as KO
from ..operators import normalize as N
from ..sources import observations as O
from . import sql as S
from .catalog import query, rounded
from .engine_queries import H, hopped

EV = S.obs()
SK = ("cohort", "signal_id")
PK = "PARTITION BY cohort, signal_id"


def r6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}::DOUBLE, {digits}) AS {n}" for n in names)


STATS = ["n", "mean", "std", "min", "max", "median", "q1", "q3", "variance", "range", "iqr", "cv"]


@query("sig_statistics", EV + """, q AS (SELECT cohort, signal_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, var_samp(value) AS variance, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_samp(value) / abs(avg(value)) AS cv FROM obs GROUP BY ALL) SELECT cohort, signal_id, """ + r6(*STATS) + " FROM q")
def sig_statistics(spark, sf):
    return rounded(N.statistics(O.obs_events(spark, sf)), SK)


@query("sig_zscore", EV + f", q AS (SELECT *, CASE WHEN stddev_samp(value) OVER p > 1e-10 THEN (value - avg(value) OVER p) / stddev_samp(value) OVER p ELSE 0 END AS z FROM obs WINDOW p AS ({PK})) SELECT cohort, signal_id, signal_0, value, round(z, 6) AS zscore, abs(z) > 3 AS is_departure FROM q")
def sig_zscore(spark, sf):
    return N.zscores(O.obs_events(spark, sf)).withColumn("zscore", F.round("zscore", 6))


_MAD = f", md AS (SELECT *, median(value) OVER ({PK}) AS med FROM obs), m2 AS (SELECT *, median(abs(value - med)) OVER ({PK}) AS mad FROM md), z AS (SELECT *, CASE WHEN mad <= 1e-10 THEN 0 ELSE 0.6745 * (value - med) / mad END AS s FROM m2)"


@query("sig_mad_departure", EV + _MAD + " SELECT cohort, signal_id, signal_0, value, round(s, 6) AS mad_score, abs(s) > 3.5 AS is_departure, CASE WHEN mad <= 1e-10 THEN 'CONSTANT' WHEN abs(s) > 5 THEN 'EXTREME' WHEN abs(s) > 3.5 THEN 'HIGH' WHEN abs(s) > 2.5 THEN 'MODERATE' WHEN abs(s) > 2 THEN 'MILD' ELSE 'NORMAL' END AS severity FROM z")
def sig_mad_departure(spark, sf):
    return N.mad_departures(O.obs_events(spark, sf)).withColumn("mad_score", F.round("mad_score", 6))


@query("sig_rolling_mad", EV + f", f AS (SELECT *, median(value) OVER z AS med, list(value) OVER z AS fr FROM obs WINDOW z AS ({PK} ORDER BY signal_0 ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)), m AS (SELECT *, list_aggregate(list_transform(fr, lambda v: abs(v - med)), 'median') AS mad FROM f) SELECT cohort, signal_id, signal_0, value, round(med, 6) AS rolling_median, round(mad, 6) AS rolling_mad, round(CASE WHEN mad > 1e-10 THEN 0.6745 * (value - med) / mad ELSE 0 END, 6) AS rolling_score FROM m")
def sig_rolling_mad(spark, sf):
    return N.rolling_mad(O.obs_events(spark, sf)).select("cohort", "signal_id", "signal_0", "value", *(F.round(c, 6).alias(c) for c in ("rolling_median", "rolling_mad", "rolling_score")))


@query("sig_correlation", S.obs("lineitem") + ", q AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, count(*) AS n, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS c FROM obs a JOIN obs b ON a.cohort = b.cohort AND a.signal_0 = b.signal_0 AND a.signal_id < b.signal_id GROUP BY ALL HAVING count(*) >= 10) SELECT cohort, signal_a, signal_b, n, round(c, 6) AS correlation FROM q")
def sig_correlation(spark, sf):
    return N.pair_correlation(O.obs_lineitem(spark, sf)).withColumn("correlation", F.round("correlation", 6))


FEATURES = ["kurtosis", "skewness", "crest_factor", "trend_slope", "trend_r2"]
_FEAT = H + """, fv AS (SELECT cohort, signal_id, k, avg(d ** 4) / avg(d * d) ** 2 - 3 AS kurtosis, avg(d ** 3) / avg(d * d) ** 1.5 AS skewness, max(abs(value)) / sqrt(avg(value * value)) AS crest_factor, regr_slope(value, i) AS trend_slope, regr_r2(value, i) AS trend_r2 FROM c GROUP BY cohort, signal_id, k)"""
_FP = _FEAT + ", fp AS (SELECT cohort, signal_id, count(*) AS n_windows, " + ", ".join(f"avg({f}) AS mean_{f}, stddev_samp({f}) AS std_{f}" for f in FEATURES) + ", covar_pop(kurtosis, crest_factor) / nullif(stddev_pop(kurtosis) * stddev_pop(crest_factor), 0) AS corr_kurtosis_crest_factor, (" + " + ".join(f"coalesce(stddev_samp({f}), 0)" for f in FEATURES) + ") / 5 AS volatility FROM fv GROUP BY cohort, signal_id)"


def features(spark, sf):
    rows = hopped(spark, sf)
    t = E.trend(rows).select(*E.KEYS, "trend_slope", "trend_r2")
    return E.statistics(rows).join(t, list(E.KEYS))


@query("gauss_fingerprint", _FP + " SELECT cohort, signal_id, n_windows, " + r6(*(f"{k}_{f}" for f in FEATURES for k in ("mean", "std")), "corr_kurtosis_crest_factor", "volatility") + " FROM fp")
def gauss_fingerprint(spark, sf):
    return rounded(N.fingerprint(features(spark, sf), FEATURES, [("kurtosis", "crest_factor")]), ("cohort", "signal_id", "n_windows"))


def _bh(f):
    return f"CASE WHEN a.std_{f} > 1e-10 AND b.std_{f} > 1e-10 THEN 0.25 * (a.mean_{f} - b.mean_{f}) ** 2 / (a.std_{f} ** 2 + b.std_{f} ** 2) + 0.5 * ln((a.std_{f} ** 2 + b.std_{f} ** 2) / (2 * a.std_{f} * b.std_{f})) END"


@query("gauss_similarity", _FP + ", q AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, " + " + ".join(f"coalesce({_bh(f)}, 0)" for f in FEATURES) + " AS distance, " + " + ".join(f"(({_bh(f)}) IS NOT NULL)::INT" for f in FEATURES) + " AS n_features, abs(a.volatility - b.volatility) AS volatility_diff FROM fp a JOIN fp b ON a.cohort = b.cohort AND a.signal_id < b.signal_id) SELECT cohort, signal_a, signal_b, n_features, round(distance, 6) AS distance, round(distance / n_features, 6) AS normalized_distance, round(exp(-distance), 6) AS similarity, round(volatility_diff, 6) AS volatility_diff FROM q")
def gauss_similarity(spark, sf):
    p = N.fingerprint(features(spark, sf), FEATURES, [])
    return rounded(N.similarity(p, FEATURES), ("cohort", "signal_a", "signal_b", "n_features"))


def _norm(name, center, scale, pre=""):
    sql = EV + pre + f", q AS (SELECT cohort, signal_id, signal_0, value, {center} AS ce, {scale} AS sc FROM {'md' if pre else 'obs'} WINDOW p AS ({PK})) SELECT cohort, signal_id, signal_0, round((value - ce) / CASE WHEN sc < 1e-10 THEN 1 ELSE sc END, 6) AS scaled FROM q"

    @query(f"norm_{name}", sql)
    def f(spark, sf):
        return N.normalise(O.obs_events(spark, sf), name).select("cohort", "signal_id", "signal_0", F.round("scaled", 6).alias("scaled"))


_norm("zscore", "avg(value) OVER p", "stddev_pop(value) OVER p")
_norm("robust", "median(value) OVER p", "quantile_cont(value, 0.75) OVER p - quantile_cont(value, 0.25) OVER p")
_norm("minmax", "min(value) OVER p", "max(value) OVER p - min(value) OVER p")
_norm("mad", "med", "1.4826 * median(abs(value - med)) OVER p", f", md AS (SELECT *, median(value) OVER ({PK}) AS med FROM obs)")


@query("norm_inverse", EV + " SELECT cohort, signal_id, signal_0, round(value, 6) AS value FROM obs")
def norm_inverse(spark, sf):
    """Undoing a normalisation gives the values back."""
    return N.denormalise(N.normalise(O.obs_events(spark, sf), "robust")).select("cohort", "signal_id", "signal_0", F.round("value", 6).alias("value"))


@query("norm_recommend", EV + f""", a AS (SELECT *, quantile_cont(value, 0.25) OVER p AS q1, quantile_cont(value, 0.75) OVER p AS q3, avg(value) OVER p AS m FROM obs WINDOW p AS ({PK})),
b AS (SELECT cohort, signal_id, avg((value - m) ** 4) / avg((value - m) ** 2) ** 2 - 3 AS ku, avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5 AS sk, avg((value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::INT) AS ou FROM a GROUP BY ALL),
g AS (SELECT cohort, avg(ou) AS o, avg(ku) AS ku, avg(abs(sk)) AS sk FROM b GROUP BY ALL) SELECT cohort, round(o, 6) AS outlier_rate, round(ku, 6) AS mean_kurtosis, round(sk, 6) AS mean_abs_skew, CASE WHEN o > 0.05 OR ku > 10 THEN 'mad' WHEN ku > 3 OR sk > 1 THEN 'robust' ELSE 'zscore' END AS method FROM g""")
def norm_recommend(spark, sf):
    return rounded(N.recommend(O.obs_events(spark, sf)), ("cohort", "method"))


_NOISE = f", r AS (SELECT *, row_number() OVER z - 1 AS r, list(value) OVER (z ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS fr, value - lag(value) OVER z AS df, list(value) OVER (z ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS l0, list(value) OVER (z ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING) AS l1 FROM obs WINDOW z AS ({PK} ORDER BY signal_0)), nf AS (SELECT *, greatest(1.4826 * list_aggregate(list_transform(fr, lambda v: abs(v - list_aggregate(fr, 'median'))), 'median'), 1e-10) AS noise, list_concat(coalesce(l0, []), coalesce(l1, [])) AS ar FROM r)"


@query("break_derivative", EV + _NOISE + " SELECT cohort, signal_id, signal_0, round(noise, 6) AS noise, CASE WHEN abs(df) / noise > 2.5 THEN round(abs(df) / noise, 6) END AS score_d FROM nf")
def break_derivative(spark, sf):
    d = B.derivative_breaks(B.noise_floor(B.prepared(O.obs_events(spark, sf))), 2.0)
    return d.select("cohort", "signal_id", "signal_0", F.round("noise", 6).alias("noise"), F.round("score_d", 6).alias("score_d"))


@query("break_spikes", EV + _NOISE + ", a AS (SELECT *, list_aggregate(ar, 'median') AS am FROM nf), b AS (SELECT *, 1.4826 * list_aggregate(list_transform(ar, lambda v: abs(v - am)), 'median') AS sp FROM a) SELECT cohort, signal_id, signal_0, round(abs(value - am) / sp, 6) AS score_s FROM b WHERE sp >= 1.4826e-10 AND abs(value - am) / sp > 1.25")
def break_spikes(spark, sf):
    s = B.spikes(B.interpolated(O.obs_events(spark, sf)), 4.0)
    return s.filter("score_s is not null").select("cohort", "signal_id", "signal_0", F.round("score_s", 6).alias("score_s"))


@query("break_interpolation", EV + f""", h AS (SELECT cohort, signal_id, signal_0, CASE WHEN signal_0 % 7 IN (3, 4) THEN NULL ELSE value END AS v FROM obs),
a AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS rn FROM h), b AS (SELECT *, last_value(v IGNORE NULLS) OVER bk AS v0, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER bk AS r0, first_value(v IGNORE NULLS) OVER fw AS v1, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER fw AS r1 FROM a WINDOW bk AS (PARTITION BY cohort, signal_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fw AS (PARTITION BY cohort, signal_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT cohort, signal_id, signal_0, round(coalesce(v, v0 + (v1 - v0) * (rn - r0) / nullif(r1 - r0, 0), v0, v1), 6) AS value FROM b""")
def break_interpolation(spark, sf):
    """Missing values (here two of seven) are filled on the line between their neighbours."""
    o = O.obs_events(spark, sf)
    holes = o.withColumn("value", F.when((F.col("signal_0") % 7).isin(3.0, 4.0), F.lit(None).cast("double")).otherwise(F.col("value")))
    return B.interpolated(holes).select("cohort", "signal_id", "signal_0", F.round("value", 6).alias("value"))


def _cusum(sensitivity: float) -> str:
    """cs: the alarm sums sample by sample, score where they alarm."""
    return f""", xs AS (SELECT cohort, signal_id, r, value, noise FROM nf), cs AS (SELECT cohort, signal_id, r, value * 0.95::DOUBLE + value * 0.05::DOUBLE AS m, 0::DOUBLE AS up, 0::DOUBLE AS down, NULL::DOUBLE AS score FROM xs WHERE r = 0
UNION ALL SELECT cohort, signal_id, r, CASE WHEN hit THEN value ELSE m * 0.95::DOUBLE + value * 0.05::DOUBLE END, CASE WHEN hit THEN 0 ELSE up END, CASE WHEN hit THEN 0 ELSE down END, CASE WHEN hit THEN greatest(up, down) END
FROM (SELECT *, greatest(up, down) > {4 / sensitivity!r}::DOUBLE AS hit FROM (SELECT x.cohort, x.signal_id, x.r, x.value, s.m, greatest(0, s.up + (x.value - s.m) / x.noise - 0.5::DOUBLE) AS up, greatest(0, s.down - (x.value - s.m) / x.noise - 0.5::DOUBLE) AS down FROM cs s JOIN xs x ON x.cohort = s.cohort AND x.signal_id = s.signal_id AND x.r = s.r + 1)))"""


_RECURSIVE = "WITH RECURSIVE" + EV.removeprefix("WITH") + _NOISE


@query("break_cusum", _RECURSIVE + _cusum(1.0) + " SELECT cohort, signal_id, r, round(score, 6) AS score FROM cs WHERE score IS NOT NULL")
def break_cusum(spark, sf):
    a = B.cusum_alarms(B.noise_floor(B.prepared(O.obs_events(spark, sf))))
    return a.select("cohort", "signal_id", "r", F.round("score", 6).alias("score"))


def _breaks(s: float) -> str:
    """bk: the breaks; candidates of the three detectors are merged one after another."""
    limit = f"{5 / s!r}::DOUBLE"
    return _RECURSIVE + _cusum(s) + f""", sp0 AS (SELECT *, list_aggregate(ar, 'median') AS am FROM nf), sp1 AS (SELECT *, 1.4826 * list_aggregate(list_transform(ar, lambda v: abs(v - am)), 'median') AS sp FROM sp0),
cand AS (SELECT cohort, signal_id, r, max(score) AS score FROM (SELECT cohort, signal_id, r, abs(df) / noise AS score FROM nf WHERE abs(df) / noise > {limit} UNION ALL SELECT cohort, signal_id, r, abs(value - am) / sp FROM sp1 WHERE sp >= 1.4826e-10 AND abs(value - am) / sp > {limit}
UNION ALL SELECT cohort, signal_id, r, score FROM cs WHERE score IS NOT NULL) GROUP BY ALL), num AS (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY r) AS j FROM cand),
mg AS (SELECT cohort, signal_id, j, r AS lr, score AS ls, 1 AS g FROM num WHERE j = 1 UNION ALL SELECT n.cohort, n.signal_id, n.j, CASE WHEN n.r - m.lr >= 10 OR n.score > m.ls THEN n.r ELSE m.lr END, CASE WHEN n.r - m.lr >= 10 OR n.score > m.ls THEN n.score ELSE m.ls END, m.g + (n.r - m.lr >= 10)::INT FROM mg m JOIN num n ON n.cohort = m.cohort AND n.signal_id = m.signal_id AND n.j = m.j + 1),
kept AS (SELECT cohort, signal_id, arg_max(lr, j) AS r FROM mg GROUP BY cohort, signal_id, g),
fw AS (SELECT cohort, signal_id, signal_0, value, r, noise, list(value) OVER (z ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS bf, list(value) OVER (z ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING) AS af FROM nf WINDOW z AS ({PK} ORDER BY signal_0)),
lv AS (SELECT fw.*, coalesce(list_aggregate(bf, 'median'), value) AS pre, coalesce(list_aggregate(af, 'median'), value) AS post FROM fw JOIN kept USING (cohort, signal_id, r)),
sz AS (SELECT *, CASE WHEN abs(value - pre) > 2 * abs(post - pre) THEN value - pre ELSE post - pre END AS size, coalesce(nullif(list_position(list_transform(af[1:20], lambda v: abs(v - post) < 2 * noise), true), 0), 20)::INT AS duration FROM lv),
bk AS (SELECT cohort, signal_id, signal_0, sign(size)::INT AS direction, duration, abs(size) AS magnitude, abs(size) / greatest(duration, 1) AS sharpness, pre AS pre_level, post AS post_level, abs(size) / noise AS snr FROM sz)"""


_BREAKS = _breaks(1.5) + " SELECT cohort, signal_id, signal_0, direction, duration, " + r6("magnitude", "sharpness", "pre_level", "post_level", "snr") + " FROM bk"


def _shown(b):
    return b.select("cohort", "signal_id", "signal_0", F.col("direction").cast("int").alias("direction"), "duration", *(F.round(c, 6).alias(c) for c in ("magnitude", "sharpness", "pre_level", "post_level", "snr")))


@query("breaks_full", _BREAKS)
def breaks_full(spark, sf):
    return _shown(KO.breaks(O.obs_events(spark, sf), 1.5))


@query("breaks_plan", _BREAKS)
def breaks_plan(spark, sf):
    """The same detectors as window frames and array folds."""
    return _shown(B.detect(O.obs_events(spark, sf), 1.5))


@query("break_summary", _breaks(1.5) + ", gp AS (SELECT *, signal_0 - lag(signal_0) OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS gap FROM bk), bs AS (SELECT cohort, signal_id, count(*) AS n_breaks, avg(gap) AS mean_spacing, stddev_pop(gap) / nullif(avg(gap), 0) AS spacing_cv, max(magnitude) AS max_magnitude, avg(magnitude) AS mean_magnitude, avg(sharpness) AS mean_sharpness, avg(snr) AS mean_snr FROM gp GROUP BY cohort, signal_id) SELECT cohort, signal_id, " + r6("n_breaks", "mean_spacing", "spacing_cv", "max_magnitude", "mean_magnitude", "mean_sharpness", "mean_snr") + " FROM bs")
def break_summary(spark, sf):
    return rounded(B.summary(KO.breaks(O.obs_events(spark, sf), 1.5)), SK)
