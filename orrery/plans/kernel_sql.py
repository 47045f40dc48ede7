"""SQL of the numeric kernels over hop windows: Fourier sums, analytic signals, block statistics, pairs of templates.

Each function continues the windows of `sql.hops` and ends in a table q of (cohort, signal_id, k, outputs).
"""

from __future__ import annotations

import numpy as np

from ..functions import kernels as K
from . import sql as S

K3 = "cohort, signal_id, k"
BY = f"PARTITION BY {K3}"


def fourier(n: int) -> str:
    """ft: sums over the centred window for each frequency f / n; ps: power."""
    turn = f"2 * pi() * ((f * i) % {n}) / {n}"
    return f""", ft AS (SELECT {K3}, f, sum(d * cos({turn})) AS re, sum(d * sin({turn})) AS im FROM c, (SELECT unnest(range(1, {n // 2 + 1})) AS f) GROUP BY ALL),
ps AS (SELECT {K3}, f, f / {n} AS fr, (re * re + im * im) / {n} AS p, sum((re * re + im * im) / {n}) OVER ({BY}) AS tp FROM ft)"""


def analytic(n: int) -> str:
    """an: real and imaginary part of the centred window's analytic signal at each place t (n even)."""
    turn = f"2 * pi() * ((f * t) % {n}) / {n}"
    return f""", an AS (SELECT {K3}, t, sum(h * (re * cos(th) + im * sin(th))) / {n} AS ar, sum(h * (re * sin(th) - im * cos(th))) / {n} AS ai
FROM (SELECT *, CASE WHEN f = {n // 2} THEN 1 ELSE 2 END AS h, {turn} AS th FROM ft, (SELECT unnest(range({n})) AS t)) GROUP BY ALL)"""


def spectral(n: int) -> str:
    return fourier(n) + f""", q AS (SELECT {K3}, arg_max(fr, p) AS dominant_freq, -sum(p / tp * log2(p / tp)) / log2({n // 2}) AS spectral_entropy, sum(fr * p / tp) AS spectral_centroid,
sqrt(sum(fr * fr * p / tp) - sum(fr * p / tp) ** 2) AS spectral_bandwidth, regr_slope(ln(p), ln(fr)) AS spectral_slope, exp(avg(ln(p))) / avg(p) AS spectral_flatness FROM ps GROUP BY {K3})"""


def frequency_bands(n: int) -> str:
    band = {"low": "2 * fr <= 0.1", "mid": "2 * fr >= 0.1 AND 2 * fr <= 0.5", "high": "2 * fr >= 0.5"}
    parts = ", ".join(f"coalesce(sum(p) FILTER ({w}), 0) AS band_{b}, coalesce(sum(p) FILTER ({w}), 0) / (any_value(tp) + 1e-10) AS band_{b}_rel" for b, w in band.items())
    return fourier(n) + f", q AS (SELECT {K3}, {parts}, any_value(tp) AS total_power FROM ps GROUP BY {K3})"


def harmonics(n: int) -> str:
    return fourier(n) + f""", hk AS (SELECT {K3}, arg_max(f, p) AS f0, any_value(tp) AS tp FROM ps GROUP BY {K3}),
hm AS (SELECT hk.cohort, hk.signal_id, hk.k, f0, hk.tp, m, coalesce(ps.p, 0) AS pm FROM hk CROSS JOIN (SELECT unnest(range(1, 11)) AS m) LEFT JOIN ps ON ps.cohort = hk.cohort AND ps.signal_id = hk.signal_id AND ps.k = hk.k AND ps.f = m * f0),
h1 AS (SELECT {K3}, any_value(f0) AS f0, any_value(tp) AS tp, max(pm) FILTER (m = 1) AS p1, max(pm) FILTER (m = 2) AS p2, max(pm) FILTER (m = 3) AS p3, sum(pm) FILTER (m >= 2) AS ov, sum(pm) FILTER (m <= 5) AS five FROM hm GROUP BY {K3}),
hn AS (SELECT {K3}, count(*) FILTER (m >= 2 AND pm > 0.01 * p1) AS found FROM hm JOIN h1 USING ({K3}) GROUP BY {K3}),
q AS (SELECT {K3}, f0 / {n} AS fundamental_freq, sqrt(p1) AS fundamental_amplitude, p1 / tp AS fundamental_ratio, sqrt(p2) AS harmonic_2x, sqrt(p3) AS harmonic_3x, 100 * sqrt(ov / p1) AS thd_percent, 20 * log10(greatest(sqrt(ov / p1), 1e-12)) AS thd_db,
found AS n_harmonics_found, five / (tp - five) AS harmonic_ratio FROM h1 JOIN hn USING ({K3}))"""


def snr(n: int) -> str:
    top = max(1, n // 2 // 10)
    return fourier(n) + f""", pr AS (SELECT *, row_number() OVER ({BY} ORDER BY p DESC) AS rk FROM ps), s1 AS (SELECT {K3}, sum(p) FILTER (rk <= {top}) AS s, greatest(sum(p) FILTER (rk > {top}), 1e-12) AS z FROM pr GROUP BY {K3}),
q AS (SELECT {K3}, 10 * log10(greatest(s / z, 1e-12)) AS snr_db, s / z AS snr_linear, s AS signal_power, z AS noise_power FROM s1)"""


def envelope(n: int) -> str:
    return fourier(n) + analytic(n) + f""", en AS (SELECT {K3}, sqrt(ar * ar + ai * ai) AS e FROM an), em AS (SELECT *, e - avg(e) OVER ({BY}) AS de FROM en),
q AS (SELECT {K3}, sqrt(avg(e * e)) AS envelope_rms, max(e) AS envelope_peak, avg(de ** 4) / avg(de * de) ** 2 - 3 AS envelope_kurtosis FROM em GROUP BY {K3})"""


def phase_coherence(n: int) -> str:
    part = n // 4
    return fourier(n) + analytic(n) + f""", ph AS (SELECT {K3}, t // {part} AS sg, t % {part} AS ps_, atan2(ai, ar) AS ph FROM an),
pc AS (SELECT a.cohort, a.signal_id, a.k, a.sg, sqrt(avg(cos(b.ph - a.ph)) ** 2 + avg(sin(b.ph - a.ph)) ** 2) AS co FROM ph a JOIN ph b ON a.cohort = b.cohort AND a.signal_id = b.signal_id AND a.k = b.k AND b.sg = a.sg + 1 AND a.ps_ = b.ps_ GROUP BY ALL),
q AS (SELECT {K3}, avg(co) AS phase_coherence, stddev_pop(co) AS coherence_std, regr_slope(co, sg) AS coherence_trend FROM pc GROUP BY {K3})"""


def hilbert_stability(n: int, name: str = "q") -> str:
    return f""", mm AS (SELECT {K3}, avg(value) AS m FROM c GROUP BY {K3}), ha AS (SELECT {K3}, t, atan2(ai, ar + m) AS ph, sqrt((ar + m) ** 2 + ai * ai) AS amp FROM an JOIN mm USING ({K3})),
hw AS (SELECT *, ph - lag(ph) OVER ({BY} ORDER BY t) AS w FROM ha), hf AS (SELECT *, w - 2 * pi() * round(w / (2 * pi())) AS dw FROM hw), hg AS (SELECT *, dw / (2 * pi()) AS f, dw / (2 * pi()) - avg(dw / (2 * pi())) OVER ({BY}) AS df FROM hf),
{name} AS (SELECT {K3}, avg(f) AS inst_freq_mean, stddev_pop(f) AS inst_freq_std, CASE WHEN abs(avg(f)) > 1e-12 THEN least(greatest(1 - stddev_pop(f) / abs(avg(f)), 0), 1) ELSE 0 END AS inst_freq_stability,
avg(df ** 4) / avg(df * df) ** 2 - 3 AS inst_freq_kurtosis, avg(df ** 3) / avg(df * df) ** 1.5 AS inst_freq_skewness, max(f) - min(f) AS inst_freq_range, regr_slope(f, t) AS inst_freq_drift, stddev_pop(amp) / avg(amp) AS inst_amp_cv,
regr_slope(amp, t) AS inst_amp_trend, avg(cos(dw)) AS hilbert_phase_coherence, stddev_pop(amp) / stddev_pop(f) AS am_fm_ratio FROM hg GROUP BY {K3})"""


def wavelet_stability(n: int, name: str = "q") -> str:
    bins, w = n // 2 + 1, max(n // 10, 2)
    return f""", ws AS (SELECT {K3}, 0 AS f, sum(value) ** 2 AS p FROM c GROUP BY {K3} UNION ALL SELECT {K3}, f, re * re + im * im FROM ft),
we AS (SELECT {K3}, sum(p) AS tot, sum(p) FILTER (f < {bins // 3}) AS lo, sum(p) FILTER (f >= {bins // 3} AND f < {2 * bins // 3}) AS mi, sum(p) FILTER (f >= {2 * bins // 3}) AS hi FROM ws GROUP BY {K3}),
wr0 AS (SELECT {K3}, i, sum(value * value) OVER ({BY} ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS e FROM c), wr1 AS (SELECT *, e - avg(e) OVER ({BY}) AS de FROM wr0 WHERE i >= {w - 1}),
wr AS (SELECT {K3}, regr_slope(e, i) AS dr, stddev_pop(e) AS sd, avg(de ** 4) / avg(de * de) ** 2 - 3 AS ku FROM wr1 GROUP BY {K3}),
{name} AS (SELECT {K3}, lo / tot AS wavelet_energy_low, mi / tot AS wavelet_energy_mid, hi / tot AS wavelet_energy_high, lo / hi AS wavelet_energy_ratio, -(lo / tot * ln(lo / tot) + mi / tot * ln(mi / tot) + hi / tot * ln(hi / tot)) AS wavelet_entropy,
greatest(lo, mi, hi) / tot AS wavelet_concentration, CASE WHEN lo >= mi AND lo >= hi THEN 0 WHEN mi >= hi THEN 1 ELSE 2 END AS wavelet_dominant_scale, dr AS wavelet_energy_drift, sd AS wavelet_temporal_std, ku AS wavelet_intermittency FROM we JOIN wr USING ({K3}))"""


def memory(n: int, name: str = "q") -> str:
    ks = np.unique(np.geomspace(10, min(n // 4, 500), 24).astype(int)).tolist()
    return f""", bl AS (SELECT {K3}, kk, i // kk AS b, i % kk AS j, value FROM c, (SELECT unnest({ks}) AS kk) WHERE i < {n} // kk * kk),
bm AS (SELECT *, value - avg(value) OVER p AS dv, stddev_pop(value) OVER p AS sd FROM bl WINDOW p AS ({BY}, kk, b)), bc AS (SELECT *, sum(dv) OVER ({BY}, kk, b ORDER BY j) AS cs FROM bm),
br AS (SELECT {K3}, kk, b, (max(cs) - min(cs)) / any_value(sd) AS rs FROM bc GROUP BY {K3}, kk, b HAVING any_value(sd) > 1e-12), bp AS (SELECT {K3}, kk, ln(greatest(avg(rs), 1e-12)) AS lr FROM br GROUP BY {K3}, kk),
{name} AS (SELECT {K3}, regr_slope(lr, ln(kk)) AS hurst, regr_r2(lr, ln(kk)) AS hurst_r2 FROM bp GROUP BY {K3})"""


def dfa(n: int, name: str = "q") -> str:
    ks = np.unique(np.geomspace(4, n // 4, 12).astype(int)).tolist()
    return f""", zc AS (SELECT *, sum(d) OVER ({BY} ORDER BY i) AS z FROM c), zr AS (SELECT {K3}, kk, i // kk AS b, regr_syy(z, i) - regr_sxy(z, i) ** 2 / regr_sxx(z, i) AS rss FROM zc, (SELECT unnest({ks}) AS kk) WHERE i < {n} // kk * kk GROUP BY {K3}, kk, i // kk),
zp AS (SELECT {K3}, kk, 0.5 * ln(greatest(sum(rss) / (count(*) * kk), 1e-24)) AS lf FROM zr GROUP BY {K3}, kk), {name} AS (SELECT {K3}, regr_slope(lf, ln(kk)) AS dfa FROM zp GROUP BY {K3})"""


def templates(n: int) -> str:
    """pa: for each template, how many match it (of two and of three samples, within a fifth of the deviation)."""
    near = lambda *v: " AND ".join(f"abs(x.{c} - y.{c}) <= x.tol" for c in v)
    two, three = near("v0", "v1"), near("v0", "v1", "v2")
    return f""", tp AS (SELECT {K3}, i, value AS v0, lead(value, 1) OVER o AS v1, lead(value, 2) OVER o AS v2, 0.2 * stddev_pop(value) OVER ({BY}) AS tol FROM c WINDOW o AS ({BY} ORDER BY i)),
pa AS (SELECT x.cohort, x.signal_id, x.k, x.i, count(*) FILTER (x.i < {n - 1} AND y.i < {n - 1} AND {two}) AS c2, count(*) FILTER (x.i < {n - 2} AND y.i < {n - 2} AND {three}) AS c3,
count(*) FILTER (x.i < {n - 2} AND y.i < {n - 2} AND x.i <> y.i AND {two}) AS b, count(*) FILTER (x.i < {n - 2} AND y.i < {n - 2} AND x.i <> y.i AND {three}) AS a FROM tp x JOIN tp y ON x.cohort = y.cohort AND x.signal_id = y.signal_id AND x.k = y.k GROUP BY ALL)"""


_SE = "CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN -ln(sum(a) / sum(b)) END"


def complexity(n: int, name: str = "q") -> str:
    return templates(n) + f""", se AS (SELECT {K3}, {_SE} AS sample_entropy, avg(ln(c2 / {n - 1})) FILTER (i < {n - 1}) - avg(ln(c3 / {n - 2})) FILTER (i < {n - 2}) AS approximate_entropy FROM pa GROUP BY {K3}),
po AS (SELECT {K3}, (v1 < v0)::INT * 4 + (v2 < v0)::INT * 2 + (v2 < v1)::INT AS code, count(*) AS m FROM tp WHERE v2 IS NOT NULL GROUP BY ALL), pe AS (SELECT {K3}, -sum(m / {n - 2} * log2(m / {n - 2})) / log2(6) AS permutation_entropy FROM po GROUP BY {K3}),
{name} AS (SELECT * FROM se JOIN pe USING ({K3}))"""


def lof(n: int, near: int = 20) -> str:
    return f""", ld AS (SELECT x.cohort, x.signal_id, x.k, x.i, y.i AS j, abs(x.value - y.value) AS dist FROM c x JOIN c y ON x.cohort = y.cohort AND x.signal_id = y.signal_id AND x.k = y.k AND x.i <> y.i),
ln_ AS (SELECT *, row_number() OVER ({BY}, i ORDER BY dist, j) AS rk FROM ld), lk AS (SELECT * FROM ln_ WHERE rk <= {near}), lr AS (SELECT {K3}, i, max(dist) AS reach FROM lk GROUP BY {K3}, i),
lx AS (SELECT lk.cohort, lk.signal_id, lk.k, lk.i, 1 / greatest(avg(greatest(dist, reach)), 1e-12) AS dens FROM lk JOIN lr ON lr.cohort = lk.cohort AND lr.signal_id = lk.signal_id AND lr.k = lk.k AND lr.i = lk.j GROUP BY ALL),
lf AS (SELECT lk.cohort, lk.signal_id, lk.k, lk.i, avg(o.dens) / any_value(me.dens) AS f FROM lk JOIN lx o ON o.cohort = lk.cohort AND o.signal_id = lk.signal_id AND o.k = lk.k AND o.i = lk.j JOIN lx me ON me.cohort = lk.cohort AND me.signal_id = lk.signal_id AND me.k = lk.k AND me.i = lk.i GROUP BY ALL),
q AS (SELECT {K3}, max(f) AS lof_max, avg(f) AS lof_mean, avg((f > 1.5)::INT) AS outlier_fraction, sum((f > 1.5)::INT) AS n_outliers FROM lf GROUP BY {K3})"""


def _embedded(n: int, dim: int, name: str) -> str:
    lead = ", ".join(f"lead(value, {j}) OVER o AS e{j}" for j in range(1, dim))
    dist = " + ".join(f"(x.e{j} - y.e{j}) ** 2" for j in range(dim))
    return f""", m{name} AS (SELECT * FROM (SELECT {K3}, i, value AS e0, {lead} FROM c WINDOW o AS ({BY} ORDER BY i)) WHERE i < {n - dim + 1}),
d{name} AS (SELECT x.cohort, x.signal_id, x.k, x.i AS a, y.i AS b, sqrt({dist}) AS dist FROM m{name} x JOIN m{name} y ON x.cohort = y.cohort AND x.signal_id = y.signal_id AND x.k = y.k AND x.i < y.i)"""


def rqa(n: int, name: str = "q") -> str:
    m = n - 2
    return _embedded(n, 3, "r") + f""", th AS (SELECT {K3}, quantile_cont(dist, 0.1) AS th FROM dr GROUP BY {K3}), hit AS (SELECT dr.cohort, dr.signal_id, dr.k, a, b FROM dr JOIN th USING ({K3}) WHERE dist <= th),
dg AS (SELECT *, a - row_number() OVER ({BY}, b - a ORDER BY a) AS isl FROM hit), dl AS (SELECT {K3}, b - a AS lg, isl, count(*) AS len FROM dg GROUP BY {K3}, b - a, isl),
fu AS (SELECT {K3}, a, b FROM hit UNION ALL SELECT {K3}, b, a FROM hit UNION ALL SELECT {K3}, i, i FROM mr), vg AS (SELECT *, a - row_number() OVER ({BY}, b ORDER BY a) AS isl FROM fu), vl AS (SELECT {K3}, b, isl, count(*) AS len FROM vg GROUP BY {K3}, b, isl),
d1 AS (SELECT {K3}, 2 * sum(len) / ({m} * {m - 1}) AS recurrence_rate, coalesce(sum(len) FILTER (len >= 2), 0) / sum(len) AS determinism FROM dl GROUP BY {K3}),
v1 AS (SELECT {K3}, coalesce(sum(len) FILTER (len >= 2), 0) / sum(len) AS laminarity, coalesce(avg(len) FILTER (len >= 2), 0) AS trapping_time FROM vl GROUP BY {K3}),
eh AS (SELECT {K3}, len, count(*) AS m FROM dl WHERE len >= 2 GROUP BY {K3}, len), ei AS (SELECT *, m / sum(m) OVER ({BY}) AS p FROM eh), e1 AS (SELECT {K3}, -sum(p * ln(p)) AS entropy_rqa FROM ei GROUP BY {K3})""" + correlation_dimension(n) + f""",
{name} AS (SELECT {K3}, recurrence_rate, determinism, laminarity, trapping_time, coalesce(entropy_rqa, 0) AS entropy_rqa, correlation_dimension FROM d1 JOIN v1 USING ({K3}) LEFT JOIN e1 USING ({K3}) LEFT JOIN cd USING ({K3}))"""


def correlation_dimension(n: int) -> str:
    return _embedded(n, 5, "c") + f""", cq AS (SELECT {K3}, quantile_cont(dist, 0.05) AS lo, quantile_cont(dist, 0.5) AS hi, count(*) AS n FROM dc WHERE dist > 1e-12 GROUP BY {K3}),
cr AS (SELECT {K3}, n, CASE j WHEN 0 THEN lo WHEN 11 THEN hi ELSE exp(ln(lo) + j / 11 * (ln(hi) - ln(lo))) END AS rad, j FROM cq, (SELECT unnest(range(12)) AS j)),
cc AS (SELECT cr.cohort, cr.signal_id, cr.k, j, any_value(rad) AS rad, count(*) / any_value(n) AS share FROM cr JOIN dc ON dc.cohort = cr.cohort AND dc.signal_id = cr.signal_id AND dc.k = cr.k AND dist > 1e-12 AND dist <= rad GROUP BY ALL),
cd AS (SELECT {K3}, regr_slope(ln(share), ln(rad)) AS correlation_dimension FROM cc GROUP BY {K3})"""


def acf(name: str = "q") -> str:
    """Autocorrelation at lags 1 and 10 and the first lag under one half."""
    return f""", ac0 AS (SELECT x.cohort, x.signal_id, x.k, y.i - x.i AS lag, sum(x.d * y.d) AS s, any_value(x.m) AS m FROM c x JOIN c y ON x.cohort = y.cohort AND x.signal_id = y.signal_id AND x.k = y.k AND y.i BETWEEN x.i AND x.i + least(50, x.m // 2) GROUP BY ALL),
ac1 AS (SELECT *, s / nullif(max(s) FILTER (lag = 0) OVER ({BY}), 0) AS r FROM ac0), {name} AS (SELECT {K3}, max(r) FILTER (lag = 1) AS acf_lag1, max(r) FILTER (lag = 10) AS acf_lag10, min(lag) FILTER (lag > 0 AND r < 0.5) AS acf_half_life FROM ac1 GROUP BY {K3})"""


def per_window(body: str, outputs, window: int = 64, stride: int = 32, digits: dict[str, int] | None = None) -> str:
    """The table that kernel_ops.per_window gives, rounded: k and the ends of each window, then the outputs."""
    cols = ", ".join(f"round({o}::DOUBLE, {(digits or {}).get(o, 6)}) AS {o}" for o in outputs)
    return S.hops(window, stride) + body + f", ends AS (SELECT {K3}, min(signal_0) AS s0, max(signal_0) AS s1 FROM w GROUP BY {K3}) SELECT cohort, signal_id, k::DOUBLE AS k, s0 AS signal_0_start, s1 AS signal_0_end, {cols} FROM ends JOIN q USING ({K3})"


#: Outputs in the square or the unit of the signal, rounded to fewer places: sums of squares differ in the last bits.
LARGE = {"band_low": 2, "band_mid": 2, "band_high": 2, "total_power": 2, "fundamental_amplitude": 5, "harmonic_2x": 5, "harmonic_3x": 5, "thd_percent": 5, "signal_power": 2, "noise_power": 2, "envelope_rms": 4,
         "envelope_peak": 4, "inst_amp_trend": 5, "am_fm_ratio": 3, "wavelet_energy_ratio": 3, "wavelet_energy_drift": 2, "wavelet_temporal_std": 2, "harmonic_ratio": 5, "inst_freq_kurtosis": 5}

KERNELS = {
    "spectral": spectral, "frequency_bands": frequency_bands, "harmonics": harmonics, "snr": snr, "envelope": envelope, "phase_coherence": phase_coherence, "memory": memory, "dfa": dfa, "complexity": complexity, "lof": lof, "rqa": rqa,
    "hilbert_stability": lambda n: fourier(n) + analytic(n) + hilbert_stability(n), "wavelet_stability": lambda n: fourier(n) + wavelet_stability(n),
}


def stability(window: int, stride: int, hilbert: list[str], wavelet: list[str], digits: int = 4) -> str:
    """signal_stability: mean and deviation over a cohort's signals of all measures."""
    s = S.hops(window, stride) + fourier(window) + analytic(window) + hilbert_stability(window, "qh") + wavelet_stability(window, "qw")
    aggs = ", ".join(f"round({f}({n}::DOUBLE), {min(digits, LARGE.get(n, digits))}) AS {n}_{k}" for n in [*hilbert, *wavelet] for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    return s + f" SELECT cohort, k::DOUBLE AS k, count(*)::DOUBLE AS n_signals, {aggs} FROM qh JOIN qw USING ({K3}) GROUP BY cohort, k"


def savgol_weights(window: int = 11, order: int = 3) -> str:
    """pos, j, w: weight of the j-th of `window` samples in the smoothed value at place pos among them."""
    unit = np.eye(window)
    hat = np.stack([K.savgol(row, window, order) for row in unit], 1)
    return "(VALUES " + ", ".join(f"({p}, {j}, {float(hat[p, j])!r}::DOUBLE)" for p in range(window) for j in range(window)) + ") AS hat(pos, j, w)"
