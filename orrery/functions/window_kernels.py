"""Measures of one window that the plans in operators.engines state as aggregates, as functions of its samples: for
manifests that ask for them by name. The tests hold each against its plan."""

from __future__ import annotations

import math

import numpy as np

from .kernels import NAN, clean, harmonics, moments, rqa, attractor


def only(f, *names):
    """The named outputs of a measure."""
    return lambda y: {n: f(y)[n] for n in names}


def _none(*names):
    return dict.fromkeys(names, NAN)


def _ratio(a: float, b: float) -> float:
    return float(a / b) if b else NAN


def basic(y) -> dict:
    y = clean(y)
    if len(y) < 4:
        return _none("kurtosis", "skewness", "crest_factor")
    sk, ku = moments(y)
    return {"kurtosis": ku, "skewness": sk, "crest_factor": _ratio(np.abs(y).max(), math.sqrt((y * y).mean()))}


def peak(y) -> dict:
    y = clean(y)
    return {"peak": float(np.abs(y).max()), "peak_to_peak": float(np.ptp(y))} if len(y) else _none("peak", "peak_to_peak")


def rms(y) -> dict:
    y = clean(y)
    return {"rms": float(math.sqrt((y * y).mean())) if len(y) else NAN}


def trend(y) -> dict:
    y = clean(y)
    if len(y) < 4:
        return _none("trend_slope", "trend_r2", "detrend_std", "cusum_range")
    t = np.arange(len(y))
    b, a = np.polyfit(t, y, 1)
    r, c = y - a - b * t, np.cumsum(y - y.mean())
    return {"trend_slope": float(b), "trend_r2": float(1 - r.var() / y.var()) if y.var() > 1e-20 else 0.0, "detrend_std": float(r.std()), "cusum_range": float(c.max() - c.min())}


def relative_change(y) -> dict:
    """Steps in units of the window's deviation."""
    y = clean(y)
    if len(y) < 2 or y.std() < 1e-12:
        return _none("mean_roc", "std_roc", "max_roc")
    d = np.diff(y) / y.std()
    return {"mean_roc": float(d.mean()), "std_roc": float(d.std()), "max_roc": float(np.abs(d).max())}


def change(y) -> dict:
    d = np.diff(clean(y))
    if not len(d):
        return _none("mean_rate", "max_rate", "min_rate", "rate_std", "abs_max_rate")
    return {"mean_rate": float(d.mean()), "max_rate": float(d.max()), "min_rate": float(d.min()), "rate_std": float(d.std()), "abs_max_rate": float(np.abs(d).max())}


def variance_ratio(y) -> dict:
    y = clean(y)
    if len(y) < 3:
        return _none("variance_ratio", "variance_ratio_4", "variance_ratio_8", "variance_ratio_stat")
    one = np.var(np.diff(y), ddof=1)
    of = lambda q: float(np.var(y[q:] - y[:-q], ddof=1) / (q * one)) if one > 0 and len(y) - q > 1 else 1.0
    return {"variance_ratio": of(2), "variance_ratio_4": of(4), "variance_ratio_8": of(8), "variance_ratio_stat": (of(2) - 1) / math.sqrt(2 / (len(y) - 1))}


def acf_decay(y) -> dict:
    y = clean(y)
    c = y - y.mean() if len(y) else y
    v = float(c @ c)
    if len(y) < 2 or v <= 0:
        return _none("acf_lag1", "acf_lag10", "acf_half_life")
    r = np.array([c[:-k] @ c[k:] / v for k in range(1, min(50, len(y) // 2) + 1)])
    low = np.flatnonzero(r < 0.5)
    return {"acf_lag1": float(r[0]), "acf_lag10": float(r[9]) if len(r) > 9 else NAN, "acf_half_life": float(low[0] + 1) if len(low) else NAN}


def variance_growth(y) -> dict:
    """Growth of the running sum's variance with length, and the whole's over twice the first half's."""
    s = np.cumsum(clean(y))
    n = len(s)
    at = [(k, float(s[:k].var())) for k in (n // 8, n // 4, n // 2, n) if k >= 1]
    good = [(math.log(k), math.log(v)) for k, v in at if k >= 4 and v > 0]
    x, z = np.array(good).T if good else (np.zeros(0), np.zeros(0))
    half = float(s[: n // 2].var()) if n > 1 else 0.0
    return {"variance_growth_rate": float(np.polyfit(x, z, 1)[0]) if len(good) > 1 else NAN, "variance_growth_ratio": _ratio(s.var() / 2 if n else 0.0, half)}


def pulsation(y) -> dict:
    y = clean(y)
    if not len(y):
        return _none("pulsation_index", "flow_mean", "flow_range")
    return {"pulsation_index": float(np.ptp(y) / (abs(y.mean()) + 1e-10)), "flow_mean": float(y.mean()), "flow_range": float(np.ptp(y))}


def time_constant(y, share: float = 0.7) -> dict:
    """Where most steps go one way: decay time of the line through log values, last level, fit, whether it falls."""
    y = clean(y)
    names = ("time_constant", "equilibrium_value", "fit_r2", "is_decay")
    d = np.diff(y)
    up, down = int((d > 0).sum()), int((d < 0).sum())
    if len(y) < 10 or up + down < 2 or max(up, down) < share * (up + down):
        return _none(*names)
    t, z = np.arange(len(y)), np.log(y - y.min() + 1e-10)
    slope = float(np.polyfit(t, z, 1)[0])
    if abs(slope) < 1e-15:
        return _none(*names)
    edge = max(len(y) // 10, 1)
    return dict(zip(names, (abs(1 / slope), float(y[-edge:].mean()), float(np.corrcoef(t, z)[0, 1] ** 2), float(y[:edge].mean() > y[-edge:].mean())), strict=True))


def basin(y, bins: int = 20, least: int = 100) -> dict:
    y = clean(y)
    n = len(y)
    if n < least:
        return _none("basin_stability", "transition_prob", "n_attractors")
    step = np.ptp(y) / bins
    at = np.minimum(np.floor((y - y.min()) / step), bins - 1).astype(int) if step > 0 else np.zeros(n, int)
    m = np.bincount(at)
    return {"basin_stability": float(m.max() / n), "transition_prob": float((np.diff(at) != 0).sum() / (n - 1)), "n_attractors": float((m > n / bins * 0.5).sum())}


def mann_kendall(y) -> dict:
    y = clean(y)
    n = len(y)
    if n < 10:
        return _none("mk_stat", "mk_pvalue", "mk_slope")
    i, j = np.triu_indices(n, 1)
    s = float(np.sign(y[j] - y[i]).sum())
    z = (s - np.sign(s)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return {"mk_stat": float(z), "mk_pvalue": math.erfc(abs(z) / math.sqrt(2)), "mk_slope": float(np.median((y[j] - y[i]) / (j - i)))}


def cycle_counting(y) -> dict:
    y = clean(y)
    names = ("n_cycles", "n_full_cycles", "n_half_cycles", "max_range", "mean_range", "cycle_accumulation")
    if len(y) < 4:
        return _none(*names)
    d = np.diff(y)
    turn = np.concatenate([[True], d[:-1] * d[1:] < 0, [True]])
    r = np.abs(np.diff(y[turn]))
    m, top = len(r), float(r.max())
    return dict(zip(names, (float(m // 2 + m % 2), float(m // 2), float(m % 2), top if top > 0 else NAN, float(r.mean()), float(((r / top) ** 3).sum() * 0.5) if top > 0 else NAN), strict=True))


# ---------------------------------------------------------------- levels


def levels(y, bins: int = 10) -> tuple[np.ndarray, int]:
    """Level of each sample, and the number of distinct values: right-closed equal bins if there are more than `bins`."""
    y = clean(y)
    values = np.unique(y)
    if len(values) > bins:
        return np.minimum(np.ceil((y - y.min()) / (np.ptp(y) / bins)), bins).astype(int), len(values)
    return np.searchsorted(values, y), len(values)


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def level_measures(y, bins: int = 10) -> dict:
    lev, distinct = levels(y, bins)
    if not len(lev):
        return _none(*LEVEL_COUNT, *LEVEL_HISTOGRAM, *DUTY)
    m = np.sort(np.unique(lev, return_counts=True)[1])
    n, q = len(lev), len(m)
    total = bins if distinct > bins else distinct
    p = m / n
    h, limit, top, second = _entropy(p), math.log2(q) if q > 1 else 1.0, float(p[-1]), float(p[-2]) if q > 1 else 0.0
    gini = 1 - 2 * float(np.cumsum(p).sum()) / q + 1 / q if q > 1 else 0.0
    return dict(zip((*LEVEL_COUNT, *LEVEL_HISTOGRAM, *DUTY), (
        float(q), q / max(total, 1), top, float(lev.max() - lev.min()) / max(total - 1, 1) if q > 1 else 0.0, h,
        1 - min(max(limit - h, 0.0) / limit, 1.0), min(max(gini, 0.0), 1.0), top / second if second > 0 else NAN, float(p[: max(1, int(q * 0.2))].sum()),
        second, h / limit if q > 1 else 0.0, top - float(p[0])), strict=True))


LEVEL_COUNT = ("n_levels", "level_occupancy", "dominant_level", "level_spread", "level_entropy")
LEVEL_HISTOGRAM = ("hist_uniformity", "hist_concentration", "hist_peak_ratio", "hist_tail_weight")
DUTY = ("duty_secondary", "duty_balance", "duty_range")
TRANSITIONS = ("trans_entropy", "trans_self_loop", "trans_max_self_loop", "trans_asymmetry", "trans_n_active", "trans_sparsity")


def transitions(y) -> dict:
    """Summaries of the matrix of steps from level to level, and how many steps change the level."""
    lev, _ = levels(y)
    kinds, at = np.unique(lev, return_inverse=True)
    q = len(kinds)
    if q < 2:
        return dict(zip((*TRANSITIONS, "transition_count"), (0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0) if q else [NAN] * 7, strict=True))
    m = np.zeros((q, q))
    np.add.at(m, (at[:-1], at[1:]), 1)
    row = m.sum(1, keepdims=True)
    p = np.divide(m, row, out=np.zeros_like(m), where=row > 0)
    left, t2, active = int((row > 0).sum()), float((p * p).sum()), int((m > 0).sum())
    return dict(zip((*TRANSITIONS, "transition_count"), (_entropy(p) / left, float(np.trace(p)) / q, float(np.diag(p).max()), math.sqrt(max(2 * t2 - 2 * float((p * p.T).sum()), 0.0) / t2),
                float(active), 1 - active / (q * q), float((at[1:] != at[:-1]).sum())), strict=True))


def raw_entropy(y, bins: int = 10) -> dict:
    y = clean(y)
    names = ("shannon_entropy", "normalized_entropy", "conditional_entropy", "entropy_rate", "excess_entropy")
    if not len(y):
        return _none(*names)
    _, at, m = np.unique(y, return_inverse=True, return_counts=True)
    h, q = _entropy(m / len(y)), len(m)
    c = 0.0
    if len(y) > 1:
        pair, k = np.unique(at[:-1] * q + at[1:], return_counts=True)
        row = np.bincount(at[:-1], minlength=q)[pair // q]
        c = float(-(k / (len(y) - 1) * np.log2(k / row)).sum())
    limit = math.log2(min(q, bins)) if min(q, bins) > 1 else 1.0
    return dict(zip(names, (h, h / limit, c, c, h - c), strict=True))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return np.diff(np.append(first, len(x))).astype(float), x[first]


def dwell_times(y) -> dict:
    n, _ = _runs(clean(y))
    if not len(n):
        return _none("dwell_mean", "dwell_std", "dwell_max", "dwell_min", "dwell_cv", "n_dwells")
    return {"dwell_mean": float(n.mean()), "dwell_std": float(n.std()), "dwell_max": float(n.max()), "dwell_min": float(n.min()), "dwell_cv": float(n.std() / n.mean()), "n_dwells": float(len(n))}


def mean_time_between(y) -> dict:
    n, state = _runs(levels(y)[0])
    if not len(n):
        return _none("mtb_mean", "mtb_std", "mtb_max", "mtb_min", "mtb_cv")
    m = np.array([n[state == s].mean() for s in np.unique(state)])
    return {"mtb_mean": float(m.mean()), "mtb_std": float(m.std()), "mtb_max": float(m.max()), "mtb_min": float(m.min()), "mtb_cv": float(m.std() / m.mean())}


thd = only(harmonics, "thd_percent", "thd_db", "n_harmonics_found")
fundamental_freq = only(harmonics, "fundamental_freq", "fundamental_amplitude", "fundamental_ratio")
recurrence_rate, determinism, correlation_dimension = (only(rqa, n) for n in ("recurrence_rate", "determinism", "correlation_dimension"))
embedding_dim = only(attractor, "embedding_dim")
