"""Numeric kernels: one array of samples in, named numbers out. numpy only, no Spark; NaN where undefined.

Definitions follow the literature named in each docstring; nothing here aims at another library's digits.
"""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def clean(y) -> np.ndarray:
    y = np.asarray(y, np.float64).ravel()
    return y[np.isfinite(y)]


# ---------------------------------------------------------------- spectra


def periodogram(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided, mean removed, zero frequency dropped: frequencies in cycles a sample, power."""
    y = y - y.mean()
    p = np.abs(np.fft.rfft(y)) ** 2 / len(y)
    return np.fft.rfftfreq(len(y))[1:], p[1:]


def spectral(y) -> dict:
    y = clean(y)
    keys = ("dominant_freq", "spectral_entropy", "spectral_centroid", "spectral_bandwidth", "spectral_slope", "spectral_flatness")
    if len(y) < 4:
        return dict.fromkeys(keys, NAN)
    if y.std() < 1e-12:
        return dict.fromkeys(keys, 0.0)
    f, p = periodogram(y)
    t = p.sum()
    q = p / t
    c = float((f * q).sum())
    pos = q > 0
    slope = np.polyfit(np.log(f[pos]), np.log(p[pos]), 1)[0] if pos.sum() > 2 else NAN
    return {
        "dominant_freq": float(f[p.argmax()]), "spectral_entropy": float(-(q[pos] * np.log2(q[pos])).sum() / np.log2(len(q))), "spectral_centroid": c,
        "spectral_bandwidth": float(np.sqrt(((f - c) ** 2 * q).sum())), "spectral_slope": float(slope), "spectral_flatness": float(np.exp(np.log(p[pos]).mean()) / p[pos].mean()),
    }


def frequency_bands(y) -> dict:
    """Power up to 0.1, to 0.5 and to 1 of the Nyquist frequency, edges in both neighbours."""
    y = clean(y)
    if len(y) < 4:
        return dict.fromkeys(("band_low", "band_mid", "band_high", "band_low_rel", "band_mid_rel", "band_high_rel", "total_power"), NAN)
    f, p = periodogram(y)
    u = f / 0.5
    bands = {n: float(p[(u >= a) & (u <= b)].sum()) for n, a, b in (("low", 0, 0.1), ("mid", 0.1, 0.5), ("high", 0.5, 1))}
    t = float(p.sum())
    return {f"band_{n}": v for n, v in bands.items()} | {f"band_{n}_rel": v / (t + 1e-10) for n, v in bands.items()} | {"total_power": t}


def harmonics(y, top: int = 10) -> dict:
    """Amplitudes at the dominant frequency and its multiples; total harmonic distortion."""
    y = clean(y)
    keys = ("fundamental_freq", "fundamental_amplitude", "fundamental_ratio", "harmonic_2x", "harmonic_3x", "thd_percent", "thd_db", "n_harmonics_found", "harmonic_ratio")
    if len(y) < 8 or y.std() < 1e-12:
        return dict.fromkeys(keys, NAN)
    f, p = periodogram(y)
    k = int(p.argmax())
    near = lambda m: int(np.abs(f - m * f[k]).argmin()) if m * f[k] <= f[-1] + 0.5 / len(y) else -1
    at = {m: near(m) for m in range(1, top + 1)}
    pw = {m: float(p[i]) if i >= 0 else 0.0 for m, i in at.items()}
    over = sum(pw[m] for m in range(2, top + 1))
    rest = float(p.sum()) - sum(pw[m] for m in range(1, 6))
    thd = math.sqrt(over / pw[1])
    return {
        "fundamental_freq": float(f[k]), "fundamental_amplitude": math.sqrt(pw[1]), "fundamental_ratio": pw[1] / float(p.sum()), "harmonic_2x": math.sqrt(pw[2]), "harmonic_3x": math.sqrt(pw[3]),
        "thd_percent": 100 * thd, "thd_db": 20 * math.log10(max(thd, 1e-12)), "n_harmonics_found": float(sum(at[m] >= 0 and pw[m] > 0.01 * pw[1] for m in range(2, top + 1))), "harmonic_ratio": sum(pw[m] for m in range(1, 6)) / rest if rest > 0 else math.inf,
    }


def snr(y) -> dict:
    """The strongest tenth of the bins against the rest."""
    y = clean(y)
    if len(y) < 8:
        return dict.fromkeys(("snr_db", "snr_linear", "signal_power", "noise_power"), NAN)
    p = np.sort(periodogram(y)[1])[::-1]
    k = max(1, len(p) // 10)
    s, n = float(p[:k].sum()), max(float(p[k:].sum()), 1e-12)
    return {"snr_db": 10 * math.log10(max(s / n, 1e-12)), "snr_linear": s / n, "signal_power": s, "noise_power": n}


def analytic(y: np.ndarray) -> np.ndarray:
    """Analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(y)
    h = np.zeros(n)
    h[0] = 1
    if n % 2 == 0:
        h[n // 2] = 1
        h[1 : n // 2] = 2
    else:
        h[1 : (n + 1) // 2] = 2
    return np.fft.ifft(np.fft.fft(y - y.mean()) * h)


def moments(x: np.ndarray) -> tuple[float, float]:
    """Population skewness and excess kurtosis."""
    d = x - x.mean()
    v = (d * d).mean()
    return (float((d**3).mean() / v**1.5), float((d**4).mean() / v**2 - 3)) if v > 1e-24 else (0.0, 0.0)


def envelope(y) -> dict:
    y = clean(y)
    if len(y) < 4:
        return dict.fromkeys(("envelope_rms", "envelope_peak", "envelope_kurtosis"), NAN)
    e = np.abs(analytic(y))
    return {"envelope_rms": float(np.sqrt((e * e).mean())), "envelope_peak": float(e.max()), "envelope_kurtosis": moments(e)[1]}


def phase_coherence(y, segments: int = 4) -> dict:
    y = clean(y)
    if len(y) < 16:
        return dict.fromkeys(("phase_coherence", "coherence_std", "coherence_trend"), NAN)
    ph = np.array_split(np.angle(analytic(y)), segments)
    m = min(map(len, ph))
    c = np.array([abs(np.exp(1j * (b[:m] - a[:m])).mean()) for a, b in zip(ph, ph[1:], strict=False)])
    return {"phase_coherence": float(c.mean()), "coherence_std": float(c.std()), "coherence_trend": float(np.polyfit(np.arange(len(c)), c, 1)[0])}


def hilbert_stability(y) -> dict:
    """Steadiness of instantaneous frequency, amplitude and phase of the analytic signal (of the values as they are)."""
    y = clean(y)
    keys = [f"inst_freq_{k}" for k in ("mean", "std", "stability", "kurtosis", "skewness", "range", "drift")] + ["inst_amp_cv", "inst_amp_trend", "hilbert_phase_coherence", "am_fm_ratio"]
    if len(y) < 10:
        return dict.fromkeys(keys, NAN)
    a = analytic(y) + y.mean()
    amp, step = np.abs(a), np.diff(np.unwrap(np.angle(a)))
    f = step / (2 * np.pi)
    m, s, am = float(f.mean()), float(f.std()), float(amp.std())
    sk, ku = moments(f) if s > 1e-12 else (0.0, 0.0)
    line = lambda v: float(np.polyfit(np.arange(len(v)), v, 1)[0])
    steady = float(np.clip(1 - s / abs(m), 0, 1)) if abs(m) > 1e-12 else 0.0
    values = (m, s, steady, ku, sk, float(np.ptp(f)), line(f), am / float(amp.mean()) if amp.mean() > 1e-12 else NAN, line(amp), float(np.cos(step).mean()), am / s if s > 1e-12 else NAN)
    return dict(zip(keys, values, strict=True))


def wavelet_stability(y) -> dict:
    """Energy of thirds of the spectrum (zero frequency included), entropy in nats, concentration, and how the energy of a
    rolling tenth drifts, varies and bursts."""
    y = clean(y)
    keys = [f"wavelet_{k}" for k in ("energy_low", "energy_mid", "energy_high", "energy_ratio", "entropy", "concentration", "dominant_scale", "energy_drift", "temporal_std", "intermittency")]
    if len(y) < 10:
        return dict.fromkeys(keys, NAN)
    p = np.abs(np.fft.rfft(y)) ** 2
    total = float(p.sum())
    if total < 1e-12:
        return dict.fromkeys(keys, NAN)
    n = len(p)
    part = np.array([p[: n // 3].sum(), p[n // 3 : 2 * n // 3].sum(), p[2 * n // 3 :].sum()])
    q = part / total
    pos = q[q > 0]
    w = max(len(y) // 10, 2)
    e = np.convolve(y * y, np.ones(w), "valid")
    drift = float(np.polyfit(np.arange(len(e)), e, 1)[0])
    values = (*map(float, q), float(part[0] / part[2]) if part[2] > 1e-12 else NAN, float(-(pos * np.log(pos)).sum()), float(q.max()), float(q.argmax()), drift, float(e.std()), moments(e)[1] if e.std() > 1e-12 else 0.0)
    return dict(zip(keys, values, strict=True))


# ---------------------------------------------------------------- memory and complexity


def hurst(y) -> dict:
    """Rescaled range over block lengths 10 .. min(n / 4, 500); slope and fit of the log-log line."""
    y = clean(y)
    top = min(len(y) // 4, 500)
    if top < 11 or y.std() < 1e-12:
        return {"hurst": NAN, "hurst_r2": NAN}
    ks = np.unique(np.geomspace(10, top, 24).astype(int))
    points = []
    for k in ks:
        b = y[: len(y) // k * k].reshape(-1, k)
        d = np.cumsum(b - b.mean(1, keepdims=True), 1)
        s = b.std(1)
        ok = s > 1e-12
        if ok.any():
            points.append((math.log(k), math.log(max(float(((d.max(1) - d.min(1))[ok] / s[ok]).mean()), 1e-12))))
    x, z = np.array(points).T
    if len(x) < 2:
        return {"hurst": NAN, "hurst_r2": NAN}
    slope, icept = np.polyfit(x, z, 1)
    total = ((z - z.mean()) ** 2).sum()
    return {"hurst": float(slope), "hurst_r2": float(1 - ((z - slope * x - icept) ** 2).sum() / total) if total > 0 else 0.0}


def dfa(y) -> dict:
    """Detrended fluctuation exponent (Peng 1994), linear trends."""
    y = clean(y)
    if len(y) < 20 or y.std() < 1e-12:
        return {"dfa": NAN}
    z = np.cumsum(y - y.mean())
    out = []
    for k in np.unique(np.geomspace(4, len(y) // 4, 12).astype(int)):
        b = z[: len(z) // k * k].reshape(-1, k)
        t = np.arange(k) - (k - 1) / 2
        slope = (b @ t) / (t @ t)
        r = b - b.mean(1, keepdims=True) - slope[:, None] * t
        out.append((math.log(k), 0.5 * math.log(max(float((r * r).mean()), 1e-24))))
    x, f = np.array(out).T
    return {"dfa": float(np.polyfit(x, f, 1)[0]) if len(x) > 1 else NAN}


def _templates(y: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(y, m)


def sample_entropy(y, m: int = 2, r: float = 0.2) -> float:
    """-ln(A / B), Chebyshev distance, tolerance r deviations, no self matches."""
    y = clean(y)
    if len(y) < m + 2 or y.std() < 1e-12:
        return NAN
    tol, n = r * y.std(), len(y) - m
    count = lambda k: (np.abs(_templates(y, k)[:n, None] - _templates(y, k)[None, :n]).max(2) <= tol).sum() - n
    b, a = count(m), count(m + 1)
    return float(-math.log(a / b)) if a > 0 and b > 0 else NAN


def approximate_entropy(y, m: int = 2, r: float = 0.2) -> float:
    y = clean(y)
    if len(y) < m + 2 or y.std() < 1e-12:
        return NAN
    tol = r * y.std()

    def phi(k):
        t = _templates(y, k)
        return float(np.log((np.abs(t[:, None] - t[None]).max(2) <= tol).mean(1)).mean())

    return phi(m) - phi(m + 1)


def permutation_entropy(y, m: int = 3) -> float:
    """Order patterns over log2 m!; ties keep their order."""
    y = clean(y)
    if len(y) < m:
        return NAN
    p = np.argsort(_templates(y, m), 1, kind="stable") @ (m ** np.arange(m))
    q = np.unique(p, return_counts=True)[1] / len(p)
    return float(-(q * np.log2(q)).sum() / math.log2(math.factorial(m)))


def complexity(y) -> dict:
    return {"sample_entropy": sample_entropy(y), "permutation_entropy": permutation_entropy(y), "approximate_entropy": approximate_entropy(y)}


# ---------------------------------------------------------------- embedding, exponents


def embed(y: np.ndarray, dim: int, tau: int) -> np.ndarray:
    n = len(y) - (dim - 1) * tau
    return np.stack([y[i * tau : i * tau + n] for i in range(dim)], 1) if n > 0 else np.zeros((0, dim))


def optimal_delay(y, most: int = 50, bins: int = 16) -> int:
    """First minimum of average mutual information (Fraser and Swinney 1986)."""
    y = clean(y)
    lo, hi = y.min(), y.max()
    if hi - lo < 1e-12:
        return 1
    b = np.minimum(((y - lo) / (hi - lo) * bins).astype(int), bins - 1)
    last = math.inf
    for k in range(1, min(most, len(y) // 4) + 1):
        h = np.bincount(b[:-k] * bins + b[k:], minlength=bins * bins).reshape(bins, bins) / (len(b) - k)
        px, py = h.sum(1), h.sum(0)
        nz = h > 0
        mi = float((h[nz] * np.log(h[nz] / np.outer(px, py)[nz])).sum())
        if mi > last:
            return k - 1
        last = mi
    return 1


LONG = 8192


def _leaves(z: np.ndarray, size: int) -> list[np.ndarray]:
    """Points halved along their widest side until at most `size` are together."""
    todo, out = [np.arange(len(z))], []
    while todo:
        p = todo.pop()
        if len(p) <= size:
            out.append(p)
            continue
        v = z[p, int(np.ptp(z[p], axis=0).argmax())]
        at = np.argpartition(v, len(p) // 2)
        todo += [p[at[: len(p) // 2]], p[at[len(p) // 2 :]]]
    return out


def _boxes(z: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of every leaf (rows of equal length, filled with len(z)) and the corners of its box."""
    table = np.full((len(leaves), max(map(len, leaves))), len(z))
    for i, p in enumerate(leaves):
        table[i, : len(p)] = p
    lo, hi = (np.stack([f(z[p], axis=0) for p in leaves]) for f in (np.min, np.max))
    return table, lo, hi


def _apart(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(x), len(lo)), x.dtype)
    for k in range(x.shape[1]):
        side = np.maximum(lo[:, k] - x[:, k, None], x[:, k, None] - hi[:, k])
        np.maximum(side, 0, out=side)
        side *= side
        out += side
    return out


def _tree_neighbours(z: np.ndarray, apart: int, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and index of every point's nearest at least `apart` away: each leaf against the others by the distance
    of their boxes, then only against boxes that one of its points is nearer to than to its neighbour so far. Exact, up to
    single precision."""
    leaves, n = _leaves(z, size), len(z)
    table, lo, hi = _boxes(z, leaves)
    sq = (z * z).sum(1)
    left = np.column_stack([-2 * z, np.ones(n, z.dtype)])  # left @ right.T: squared distances, less the left point's square
    right = np.vstack([np.column_stack([z, sq]), np.append(np.zeros(z.shape[1], z.dtype), np.float32(1e30))])
    near, nearest = np.full(n, np.inf, np.float32), np.zeros(n, np.int64)
    place, steps = np.full(n + 1, -1), np.arange(1 - min(apart, n), min(apart, n))
    for a, p in enumerate(leaves):
        gap = _apart(lo[a : a + 1], lo - (hi[a] - lo[a]), hi)[0]
        gap[a] = -1  # the leaf itself comes first: apart from 1 on, its points are barred there
        boxes, rows, take, first = np.argsort(gap, kind="stable"), np.arange(len(p)), 2, True
        close = p[:, None] + steps
        inside = (close >= 0) & (close < n)
        best, who = np.full(len(p), np.inf, np.float32), np.zeros(len(p), np.int64)
        while len(boxes):
            c = table[boxes[:take]].ravel()
            d = left[p[rows]] @ right[c].T
            if apart > 1 or first:
                place[c] = np.arange(len(c))
                cols = np.where(inside[rows], place[np.clip(close[rows], 0, n - 1)], -1)
                place[c] = -1
                row, col = np.nonzero(cols >= 0)
                d[row, cols[row, col]] = np.inf
            j = d.argmin(1)
            v = np.maximum(d[np.arange(len(rows)), j] + sq[p[rows]], 0)
            better = (v < best[rows]) & (c[j] < n)
            best[rows[better]], who[rows[better]] = v[better], c[j[better]]
            boxes = boxes[take:]
            if first:
                boxes = boxes[gap[boxes] <= best.max() + 1e-5]
                to = _apart(z[p], lo[boxes], hi[boxes])
            else:
                to = to[:, take:]
            due = to <= best[:, None] + 1e-5
            some = due.any(0)
            boxes, to, take, first = boxes[some], to[:, some], 8, False
            rows = np.flatnonzero(due[:, some][:, :take].any(1))
        near[p], nearest[p] = best, who
    return near, nearest


def nearest(x: np.ndarray, k: int, of: np.ndarray | None = None, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and indices of the k points of x nearest to every point of `of` (of x itself: without the point),
    ties to smaller indices; all others, if fewer. In double precision, by boxes as above."""
    own, of = of is None, x if of is None else of
    k = min(k, len(x) - own)
    table, lo, hi = _boxes(x, _leaves(x, size))
    points = np.vstack([x, np.full(x.shape[1], np.inf)])
    dist, index = np.full((len(of), k), np.inf), np.full((len(of), k), len(x))
    for p in _leaves(of, size) if k > 0 else []:
        y = of[p]
        low, high = y.min(0), y.max(0)
        gap = _apart(low[None], lo - (high - low), hi)[0]
        boxes, rows, take, first = np.argsort(gap, kind="stable"), np.arange(len(p)), 4, True
        best, who = np.full((len(p), k), np.inf), np.full((len(p), k), len(x))
        while len(boxes):
            c = table[boxes[:take]].ravel()
            z = points[c]
            d = (z[:, 0] - y[rows, 0, None]) ** 2
            for i in range(1, x.shape[1]):
                side = z[:, i] - y[rows, i, None]
                side *= side
                d += side
            if own:
                d[c == p[rows, None]] = np.inf
            d, c = np.hstack([best[rows], d]), np.hstack([who[rows], np.broadcast_to(c, d.shape)])
            got = np.argpartition(d, k - 1, axis=1)[:, :k]
            v = np.take_along_axis(d, got, 1)
            last = v.max(1)
            tied = np.isfinite(last) & ((d == last[:, None]).sum(1) > (v == last[:, None]).sum(1))
            for r in np.flatnonzero(tied):
                m = np.flatnonzero(d[r] <= last[r])
                got[r] = m[np.lexsort((c[r, m], d[r, m]))[:k]]
            best[rows], who[rows] = np.take_along_axis(d, got, 1), np.take_along_axis(c, got, 1)
            boxes, far = boxes[take:], best.max(1)[:, None] * (1 + 1e-12)
            if first:
                boxes = boxes[gap[boxes] <= far.max()]
                to = _apart(y, lo[boxes], hi[boxes])
            else:
                to = to[:, take:]
            due = to <= far
            some = due.any(0)
            boxes, to, take, first = boxes[some], to[:, some], 8, False
            rows = np.flatnonzero(due[:, some][:, :take].any(1))
        o = np.lexsort((who, best), axis=1)
        dist[p], index[p] = np.take_along_axis(best, o, 1), np.take_along_axis(who, o, 1)
    return dist, index


def _neighbours(x: np.ndarray, apart: int = 1, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Nearest other point at least `apart` steps away: distances and indices. The search runs in single precision, some
    rows of the distance matrix at a time, so long series need no more memory; those over LONG points search in a tree."""
    z = ((x - x.mean(0)) / max(float(x.std()), 1e-12)).astype(np.float32)
    if len(x) > LONG:
        near, j = _tree_neighbours(z, apart)
        return np.where(np.isfinite(near), np.sqrt(((x - x[j]) ** 2).sum(1)), np.inf), j
    sq, n = (z * z).sum(1), len(x)
    near, j = np.empty(n, np.float32), np.empty(n, np.int64)
    for a in range(0, n, block):
        rows = np.arange(a, min(a + block, n))
        d = z[rows] @ z.T
        d *= -2
        d += sq[rows, None]
        d += sq[None]
        for k in range(1 - min(apart, n), min(apart, n)):
            at = rows + k
            ok = (at >= 0) & (at < n)
            d[np.flatnonzero(ok), at[ok]] = np.inf
        j[rows] = d.argmin(1)
        near[rows] = d[np.arange(len(rows)), j[rows]]
    return np.where(np.isfinite(near), np.sqrt(((x - x[j]) ** 2).sum(1)), np.inf), j


def optimal_dimension(y, tau: int, most: int = 6, ratio: float = 10.0, share: float = 0.05) -> int:
    """Least dimension with under `share` false nearest neighbours (Kennel 1992)."""
    y = clean(y)
    for dim in range(1, most + 1):
        n = len(y) - dim * tau
        if n < 10:
            break
        d, j = _neighbours(embed(y, dim, tau)[:n])
        extra = np.abs(y[dim * tau : dim * tau + n] - y[dim * tau + j])
        ok = np.isfinite(d) & (d > 1e-12)
        if ok.any() and (extra[ok] / d[ok] > ratio).mean() < share:
            return dim
    return min(3, most)


def cao(y, tau: int, most: int = 6) -> dict:
    """Cao 1997: E1 by dimension, where it stops changing, and whether E2 says deterministic."""
    y = clean(y)
    e, s = [], []
    for dim in range(1, most + 2):
        n = len(y) - dim * tau
        if n < 10:
            break
        _, j = _neighbours(embed(y, dim, tau)[:n])
        up = embed(y, dim + 1, tau)[:n]
        low = np.abs(up[:, :dim] - up[j, :dim]).max(1)
        high = np.abs(up - up[j]).max(1)
        ok = low > 1e-12
        e.append(float((high[ok] / low[ok]).mean()) if ok.any() else 1.0)
        s.append(float(np.abs(y[dim * tau : dim * tau + n] - y[dim * tau + j]).mean()))
    e1 = [b / a for a, b in zip(e, e[1:], strict=False)]
    e2 = [b / a if a > 0 else 1.0 for a, b in zip(s, s[1:], strict=False)]
    sat = next((k + 2 for k, (a, b) in enumerate(zip(e1, e1[1:], strict=False)) if abs(b - a) < 0.05), len(e1) or 1)
    return {"dimension": sat, "is_deterministic": bool(e2) and max(abs(v - 1) for v in e2) > 0.1, "e1": e1}


def rosenstein(y, dim: int, tau: int, steps: int | None = None) -> tuple[float, np.ndarray]:
    """Largest exponent (Rosenstein 1993): slope of mean log divergence of nearest neighbours, and the curve."""
    x = embed(clean(y), dim, tau)
    n = len(x)
    steps = min(steps or 20, n // 4)
    if n < 20 or steps < 3:
        return NAN, np.zeros(0)
    m = n - steps
    _, j = _neighbours(x[:m], apart=max(tau * dim, 2))
    i = np.arange(m)
    curve = []
    for k in range(steps):
        d = np.sqrt(((x[i + k] - x[j + k]) ** 2).sum(1))
        d = d[d > 1e-12]
        curve.append(np.log(d).mean() if len(d) else np.nan)
    curve = np.array(curve)
    ok = np.isfinite(curve)
    return (float(np.polyfit(np.arange(steps)[ok], curve[ok], 1)[0]) if ok.sum() > 2 else NAN), curve


def kantz(y, dim: int, tau: int, share: float = 0.1, steps: int = 15) -> float:
    """Kantz 1994: all neighbours within a share of the attractor's extent instead of the nearest."""
    x = embed(clean(y), dim, tau)
    steps = min(steps, len(x) // 4)
    if len(x) < 20 or steps < 3:
        return NAN
    m = len(x) - steps
    d = np.sqrt(np.maximum(((x[:m, None] - x[None, :m]) ** 2).sum(2), 0))
    i = np.arange(m)
    near = (d < share * d.max()) & (np.abs(i[:, None] - i[None]) > tau)
    if not near.any():
        return NAN
    a, b = np.nonzero(near)
    curve = [float(np.log(np.maximum(np.bincount(a, np.abs(x[a + k, -1] - x[b + k, -1]), m)[near.any(1)] / near.sum(1)[near.any(1)], 1e-12)).mean()) for k in range(steps)]
    return float(np.polyfit(np.arange(steps), curve, 1)[0])


def ftle(y, direction: str = "forward", dim: int | None = None, tau: int | None = None, most: int | None = None, least: int = 60) -> dict:
    """Finite-time exponent of a series (reversed, if backward): delay by mutual information, dimension by Cao, Rosenstein
    divergence; confidence grows with the points used. NULL under `least` samples or 50 embedded points (20 of a series
    whose `least` is lower). `most`: of longer series only that many last samples."""
    y = clean(y)[-(most or len(y) or 1) :]
    y = y[::-1] if direction == "backward" else y
    empty = {"ftle": NAN, "ftle_std": NAN, "embedding_dim": NAN, "embedding_tau": NAN, "is_deterministic": NAN, "confidence": 0.0, "n_samples": float(len(y))}
    if len(y) < least or y.std() < 1e-12:
        return empty
    tau = tau or max(1, min(optimal_delay(y), len(y) // 20))
    c = cao(y, tau) if dim is None else {"dimension": dim, "is_deterministic": True}
    dim = int(np.clip(c["dimension"], 2, 6))
    if len(y) - (dim - 1) * tau < min(50, least - 10):
        return empty
    slope, curve = rosenstein(y, dim, tau)
    return {"ftle": slope, "ftle_std": float(np.nanstd(np.diff(curve))) if len(curve) > 1 else NAN, "embedding_dim": float(dim), "embedding_tau": float(tau), "is_deterministic": float(c["is_deterministic"]), "confidence": min(1.0, (len(y) - (dim - 1) * tau) / 500), "n_samples": float(len(y))}


def lyapunov(y, most: int | None = None) -> dict:
    """As ftle, with the dimension by false nearest neighbours."""
    y = clean(y)[-(most or len(y) or 1) :]
    if len(y) < 30 or y.std() < 1e-12:
        return {"lyapunov": NAN, "embedding_dim": NAN, "embedding_tau": NAN, "confidence": 0.0, "n_samples": float(len(y))}
    tau = max(1, min(optimal_delay(y), len(y) // 20))
    dim = max(2, optimal_dimension(y, tau))
    return {"lyapunov": rosenstein(y, dim, tau)[0], "embedding_dim": float(dim), "embedding_tau": float(tau), "confidence": min(1.0, len(y) / 500), "n_samples": float(len(y))}


def correlation_dimension(y, dim: int = 5, tau: int = 1) -> float:
    """Grassberger and Procaccia 1983: slope of log C(r) between its 5th and 50th percentile distances."""
    x = embed(clean(y), dim, tau)
    if len(x) < 20:
        return NAN
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))[np.triu_indices(len(x), 1)]
    d = np.sort(d[d > 1e-12])
    if len(d) < 20:
        return NAN
    r = np.geomspace(np.quantile(d, 0.05), np.quantile(d, 0.5), 12)
    c = np.searchsorted(d, r, "right") / len(d)
    return float(np.polyfit(np.log(r), np.log(c), 1)[0]) if r[-1] > r[0] else NAN


def _lines(bits: np.ndarray) -> np.ndarray:
    """Lengths of runs of ones."""
    e = np.diff(np.concatenate([[0], bits.astype(np.int8), [0]]))
    return np.flatnonzero(e == -1) - np.flatnonzero(e == 1)


def rqa(y, dim: int = 3, tau: int = 1, quantile: float = 0.1) -> dict:
    """Recurrence quantification at the distance of the given quantile: rate, determinism, laminarity, trapping time, entropy
    of diagonal lines (of 2 at least), and the correlation dimension."""
    x = embed(clean(y), dim, tau)
    keys = ("recurrence_rate", "determinism", "laminarity", "trapping_time", "entropy_rqa", "correlation_dimension")
    if len(x) < 20:
        return dict.fromkeys(keys, NAN)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    r = d <= np.quantile(d[np.triu_indices(len(x), 1)], quantile)
    n = len(x)
    off = r.sum() - n
    diagonal = np.concatenate([_lines(np.diagonal(r, k)) for k in range(1, n)] or [np.zeros(0, int)])
    vertical = np.concatenate([_lines(r[:, k]) for k in range(n)])
    dl, vl = diagonal[diagonal >= 2], vertical[vertical >= 2]
    q = np.unique(dl, return_counts=True)[1] / max(len(dl), 1)
    return dict(zip(keys, (off / (n * (n - 1)), float(dl.sum() / max(diagonal.sum(), 1)), float(vl.sum() / max(vertical.sum(), 1)), float(vl.mean()) if len(vl) else 0.0, float(-(q * np.log(q)).sum()) if len(dl) else 0.0, correlation_dimension(y)), strict=True))


def attractor(y) -> dict:
    y = clean(y)
    if len(y) < 100 or y.std() < 1e-12:
        return {"embedding_dim": NAN, "delay": NAN, "correlation_dim": NAN}
    tau = optimal_delay(y)
    dim = optimal_dimension(y, tau)
    return {"embedding_dim": float(dim), "delay": float(tau), "correlation_dim": correlation_dimension(y, max(dim, 2), tau)}


def dmd(y, rank: int = 8) -> dict:
    """Dynamic mode decomposition of the Hankel matrix of half the length."""
    y = clean(y)
    keys = ("dmd_dominant_freq", "dmd_growth_rate", "dmd_is_stable", "dmd_n_modes")
    if len(y) < 16 or y.std() < 1e-12:
        return dict.fromkeys(keys, NAN)
    h = _templates(y - y.mean(), len(y) // 2).T
    a, b = h[:, :-1], h[:, 1:]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k = int(min(rank, (s > s[0] * 1e-8).sum()))
    u, s, vt = u[:, :k], s[:k], vt[:k]
    lam, w = np.linalg.eig(u.T @ b @ vt.T / s)
    amp = np.abs(np.linalg.lstsq(w, u.T @ a[:, 0].astype(complex), rcond=None)[0])
    growth = np.log(np.maximum(np.abs(lam), 1e-12))
    i = int((amp * (np.abs(lam.imag) > 1e-9)).argmax()) if (np.abs(lam.imag) > 1e-9).any() else int(amp.argmax())
    return dict(zip(keys, (float(abs(np.angle(lam[i])) / (2 * np.pi)), float(growth[i]), float((growth <= 1e-9).all()), float(k)), strict=True))


def lof(y, k: int = 20) -> dict:
    """One-dimensional local outlier factors (Breunig 2000)."""
    y = clean(y)
    if len(y) < 5:
        return dict.fromkeys(("lof_max", "lof_mean", "outlier_fraction", "n_outliers"), NAN)
    k = min(k, len(y) - 1)
    d = np.abs(y[:, None] - y[None])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :k]
    reach_k = np.take_along_axis(d, near, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, near, 1), reach_k[near])
    density = 1 / np.maximum(reach.mean(1), 1e-12)
    f = density[near].mean(1) / density
    return {"lof_max": float(f.max()), "lof_mean": float(f.mean()), "outlier_fraction": float((f > 1.5).mean()), "n_outliers": float((f > 1.5).sum())}


# ---------------------------------------------------------------- tests and pairs


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def f_survival(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def adf(y, lags: int | None = None) -> dict:
    """Augmented Dickey-Fuller with constant; lag by AIC up to 12 (n / 100)^1/4; p by interpolating the usual critical values
    of the constant-only test (1, 2.5, 5, 10, 90, 95, 97.5, 99 %)."""
    y = clean(y)
    n = len(y)
    if n < 12:
        return {"adf_stat": NAN, "adf_pvalue": NAN, "adf_lags": NAN, "adf_nobs": NAN}
    if y.std() < 1e-12:
        return {"adf_stat": -math.inf, "adf_pvalue": 0.0, "adf_lags": 0.0, "adf_nobs": float(n)}
    dy = np.diff(y)
    top = min(int(12 * (n / 100) ** 0.25), n // 3 - 2) if lags is None else lags

    def fit(p, start):
        t = np.arange(start, len(dy))
        x = np.column_stack([np.ones(len(t)), y[t], *(dy[t - i] for i in range(1, p + 1))])
        b, *_ = np.linalg.lstsq(x, dy[t], rcond=None)
        e = dy[t] - x @ b
        s2 = e @ e / max(len(t) - x.shape[1], 1)
        se = math.sqrt(max(s2 * np.linalg.pinv(x.T @ x)[1, 1], 1e-300))
        return b[1] / se, len(t) * math.log(max(e @ e / len(t), 1e-300)) + 2 * x.shape[1], len(t)

    best = min(range(max(top, 0) + 1), key=lambda p: fit(p, top)[1]) if lags is None else top
    stat, _, used = fit(best, best)
    # fixed values: published large-sample critical values
    q, p = [-3.43, -3.12, -2.86, -2.57, -0.44, -0.07, 0.23, 0.60], [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
    return {"adf_stat": float(stat), "adf_pvalue": float(np.interp(stat, q, p)), "adf_lags": float(best), "adf_nobs": float(used)}


def granger(x, y, lag: int = 5) -> dict:
    """Does x help to predict y: F of the lags of x beside those of y."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(y)
    if n < lag + 20:
        return {"granger_f": NAN, "granger_p": NAN}
    t = np.arange(lag, n)
    own = np.column_stack([np.ones(len(t)), *(y[t - i] for i in range(1, lag + 1))])
    both = np.column_stack([own, *(x[t - i] for i in range(1, lag + 1))])
    rss = lambda m: float(((y[t] - m @ np.linalg.lstsq(m, y[t], rcond=None)[0]) ** 2).sum())
    r0, r1 = rss(own), rss(both)
    d2 = len(t) - both.shape[1]
    if r1 < 1e-18 or d2 <= 0:
        return {"granger_f": NAN, "granger_p": NAN}
    f = (r0 - r1) / lag / (r1 / d2)
    return {"granger_f": f, "granger_p": f_survival(f, lag, d2)}


def dtw(a, b, band: int = 16384) -> float:
    """Dynamic time warping distance, over all pairs of samples: bands of `band` rows, each by anti-diagonals with the last row
    of the band before on its upper side, so that what is at hand stays in a core's cache and memory is linear."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if not n or not m:
        return NAN
    above = np.full(m + 1, np.inf)  # of the row before the band: column j at j + 1
    above[0] = 0.0
    for start in range(0, n, band):
        rows = a[start : start + band]
        h = len(rows)
        # row i of the band meets column s - i on diagonal s: column after column of b, turned round
        turned = np.concatenate([np.full(h - 1, np.inf), b[::-1], np.full(h - 1, np.inf)])
        below = np.full(m + 1, np.inf)
        prev2, prev, cur = (np.full(h + 1, np.inf) for _ in range(3))  # row i at i + 1, the row above at 0
        prev2[0], prev[0] = above[0], above[1]
        cost = np.empty(h)
        for s in range(h + m - 1):
            at = h + m - 2 - s
            np.subtract(rows, turned[at : at + h], out=cost)
            np.abs(cost, out=cost)
            new = cur[1:]
            np.minimum(prev[:-1], prev[1:], out=new)
            np.minimum(new, prev2[:-1], out=new)
            new += cost
            cur[0] = above[s + 2] if s + 2 <= m else np.inf
            if s >= h - 1:
                below[s - h + 2] = cur[h]
            prev2, prev, cur = prev, cur, prev2
        above = below
    return float(above[m])


# ---------------------------------------------------------------- clouds


def eigen(x: np.ndarray, norm: str = "zscore") -> dict:
    """Spectrum of a rows x features cloud after normalisation; leading axes with their largest component positive."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x).all(1)]
    n, d = x.shape
    if n < 2 or not d:
        return {}
    med = np.median(x, 0)
    center, scale = {"zscore": (x.mean(0), x.std(0)), "robust": (med, np.subtract(*np.percentile(x, [75, 25], 0))), "mad": (med, 1.4826 * np.median(np.abs(x - med), 0)), "none": (x.mean(0), np.ones(d))}[norm]
    z = (x - center) / np.where(scale < 1e-10, 1, scale)
    lam, v = np.linalg.eigh(np.atleast_2d(np.cov(z, rowvar=False)))
    lam, v = np.maximum(lam[::-1], 0), v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1, 1)
    t = lam.sum()
    q = lam / t if t > 0 else lam
    pos = q[q > 1e-12]
    h = float(-(pos * np.log2(pos)).sum())
    return {"values": lam, "axes": v, "loadings": z @ v, "explained": q, "total_variance": float(t), "effective_dim": float(t * t / (lam @ lam)) if t > 0 else NAN, "entropy": h, "entropy_norm": h / math.log2(d) if d > 1 else 0.0, "condition_number": float(lam[0] / lam[-1]) if lam[-1] > 1e-10 else NAN}


def laplacian_view(correlation: np.ndarray) -> dict:
    """Normalised Laplacian of the |correlation| graph."""
    w = np.abs(np.nan_to_num(correlation))
    np.fill_diagonal(w, 0)
    d = w.sum(1)
    s = 1 / np.sqrt(np.where(d > 1e-12, d, 1))
    lam = np.sort(np.linalg.eigvalsh(np.eye(len(w)) - s[:, None] * w * s[None]))
    return {"algebraic_connectivity": float(lam[1]) if len(lam) > 1 else 0.0, "spectral_gap": float(lam[1] - lam[0]) if len(lam) > 1 else 0.0, "n_components": float((lam < 1e-10).sum()), "laplacian_max": float(lam[-1])}


def persistence(points: np.ndarray) -> dict[int, list[tuple[float, float]]]:
    """Vietoris-Rips pairs of dimension 0 and 1 by reduction over Z2. For small clouds (tens of points)."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    edges = sorted((float(d[i, j]), i, j) for i in range(n) for j in range(i + 1, n))
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    h0, births = [], {}
    for k, (w, i, j) in enumerate(edges):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            h0.append((0.0, w))
        else:
            births[k] = w
    number = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    tri = sorted((max(number[i, j], number[i, k], number[j, k]), i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n))
    pivot: dict[int, set] = {}
    h1 = []
    for top, i, j, k in tri:
        column = {number[i, j], number[i, k], number[j, k]}
        while column and (low := max(column)) in pivot:
            column = column ^ pivot[low]
        if column:
            low = max(column)
            pivot[low] = column
            if low in births and edges[top][0] > births[low] + 1e-12:
                h1.append((births[low], edges[top][0]))
    return {0: h0, 1: h1}


def persistence_summary(points: np.ndarray) -> dict:
    """Counts over the median persistence, entropy (over ln n), greatest and total persistence, by dimension."""
    out = {}
    for k, pairs in persistence(points).items():
        life = np.array([b - a for a, b in pairs])
        if not len(life):
            out |= {f"betti_{k}": 0.0, f"persistence_entropy_{k}": 0.0, f"max_persistence_{k}": 0.0, f"total_persistence_{k}": 0.0}
            continue
        q = life / life.sum() if life.sum() > 0 else life
        q = q[q > 0]
        out |= {f"betti_{k}": float((life > np.median(life)).sum()), f"persistence_entropy_{k}": float(-(q * np.log(q)).sum() / math.log(len(life))) if len(life) > 1 else 0.0, f"max_persistence_{k}": float(life.max()), f"total_persistence_{k}": float(life.sum())}
    return out


def savgol(y, window: int = 11, order: int = 3) -> np.ndarray:
    """Local polynomial smoothing; the ends take the fit of the nearest full window."""
    y = np.asarray(y, float)
    if len(y) < window:
        return y.copy()
    h = window // 2
    v = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(v)
    out = np.convolve(y, fit[0][::-1], "same")
    at = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    out[:h] = (at @ (fit @ y[:window]))[:h]
    out[-h:] = (at @ (fit @ y[-window:]))[-h:]
    return out


def ward(distance: np.ndarray) -> np.ndarray:
    """Ward linkage of a distance matrix by the Lance-Williams update: rows (a, b, height, size)."""
    d = np.asarray(distance, float) ** 2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        dij, si, sj = d[i, j], size[i], size[j]
        sk = np.array(size)
        new = ((si + sk) * d[i] + (sj + sk) * d[j] - sk * dij) / (si + sj + sk)
        out.append((*sorted((ids[i], ids[j])), math.sqrt(max(dij, 0)), si + sj))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids[i], size[i] = n + step, si + sj
        del ids[j], size[j]
    return np.array(out)


def cut_tree(linkage: np.ndarray, n: int, k: int) -> np.ndarray:
    member = {i: [i] for i in range(n)}
    for step, (a, b, *_) in enumerate(linkage[: n - k]):
        member[n + step] = member.pop(int(a)) + member.pop(int(b))
    out = np.empty(n, int)
    for c, rows in enumerate(sorted(member.values(), key=min)):
        out[rows] = c
    return out


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    s = []
    for i in range(len(labels)):
        own = labels == labels[i]
        if own.sum() < 2:
            s.append(0.0)
            continue
        a = distance[i, own].sum() / (own.sum() - 1)
        b = min(distance[i, labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        s.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(s))


def cluster(distance: np.ndarray, most: int = 6) -> tuple[np.ndarray, list[int]]:
    """Labels of the Ward cut of best silhouette for 2 .. most clusters, and each cluster's medoid."""
    n = len(distance)
    if n < 3:
        return np.zeros(n, int), [0] if n else []
    tree = ward(distance)
    cuts = [cut_tree(tree, n, k) for k in range(2, min(most, n - 1) + 1)]
    labels = max(cuts, key=lambda c: silhouette(distance, c))
    medoids = [int(rows[distance[np.ix_(rows, rows)].sum(1).argmin()]) for c in range(labels.max() + 1) for rows in [np.flatnonzero(labels == c)]]
    return labels, medoids


def point_ftle(x: np.ndarray, k: int = 10) -> np.ndarray:
    """Per point: growth rate of its k nearest neighbours over one step, by the Cauchy-Green tensor of a local linear map."""
    n = len(x) - 1
    out = np.full(max(n, 0), NAN)
    for i in range(n):
        d = ((x[:n] - x[i]) ** 2).sum(1)
        j = np.argsort(d)[1 : k + 1]
        a, b = x[j] - x[i], x[j + 1] - x[i + 1]
        if len(j) >= x.shape[1]:
            m = np.linalg.lstsq(a, b, rcond=None)[0]
            out[i] = 0.5 * math.log(max(float(np.linalg.eigvalsh(m @ m.T)[-1]), 1e-12))
    return out


def saddle_score(x: np.ndarray, k: int = 10) -> dict:
    """How often the local one-step map both stretches and shrinks: share of such points and mean product of rates. (Own
    definition.)"""
    n, hits, rates = len(x) - 1, 0, []
    for i in range(n):
        j = np.argsort(((x[:n] - x[i]) ** 2).sum(1))[1 : k + 1]
        if len(j) < x.shape[1]:
            continue
        m = np.linalg.lstsq(x[j] - x[i], x[j + 1] - x[i + 1], rcond=None)[0]
        s = np.linalg.svd(m, compute_uv=False)
        hits += bool(s[0] > 1.05 and s[-1] < 0.95)
        rates.append(s[0] * s[-1])
    return {"saddle_score": hits / n if n > 0 else NAN, "rate_product": float(np.mean(rates)) if rates else NAN}


def sensitivity(x: np.ndarray) -> dict:
    """Influence of each column's step on every column's next step (standardised least squares): per column sensitivity, their
    entropy, the most sensitive. (Own definition.)"""
    d = np.diff(x, axis=0)
    d = (d - d.mean(0)) / np.where(d.std(0) < 1e-12, 1, d.std(0))
    if len(d) < x.shape[1] + 2:
        return {}
    m = np.linalg.lstsq(d[:-1], d[1:], rcond=None)[0]
    s = np.sqrt((m * m).sum(1))
    q = s / s.sum() if s.sum() > 0 else s
    q = q[q > 0]
    return {"influence": m, "sensitivity": s, "entropy": float(-(q * np.log(q)).sum()), "dominant": int(s.argmax())}


def jacobians(x: np.ndarray, k: int | None = None, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Per point: real parts (ascending) of the eigenvalues of the local linear map from position to velocity, fitted to
    the k nearest points, and the speed."""
    d = x.shape[1]
    k = k or 2 * d + 1
    v = np.gradient(x, axis=0)
    out = np.full((len(x), d), NAN)
    _, j = nearest(x, k)
    if j.shape[1] > d:
        for a in range(0, len(x), block):
            b = slice(a, a + block)
            m = np.linalg.pinv(x[j[b]] - x[b, None], rcond=np.finfo(float).eps * max(j.shape[1], d)) @ (v[j[b]] - v[b, None])
            out[b] = np.sort(np.linalg.eigvals(m).real, axis=1)
    return out, np.sqrt((v * v).sum(1))


def saddle_points(x: np.ndarray, slow: float = 0.1, k: int | None = None) -> dict:
    """score of each point: how near it is to rest (speed against `slow` times the path's largest), times how evenly its
    local map both repels and attracts (0 if it does only one). basin_stability: mean of 1 - score over the points before,
    up to 50; separatrix_distance: to the nearest point scoring over one half. (Own definitions.)"""
    real, speed = jacobians(x, k)
    up, down = np.maximum(real, 0).sum(1), np.maximum(-real, 0).sum(1)
    both = 2 * np.minimum(up, down) / np.where(up + down > 0, up + down, 1)
    rest = np.exp(-speed / max(slow * float(np.nanmax(speed)), 1e-12)) if len(x) else speed
    score = both * rest
    w = max(1, min(50, len(x) // 4))
    calm = np.concatenate([[0.0], np.cumsum(1 - np.nan_to_num(score))])
    first = np.maximum(np.arange(len(x)) - w + 1, 0)
    basin = (calm[1:] - calm[first]) / (np.arange(len(x)) - first + 1)
    at = np.flatnonzero(score > 0.5)
    apart = np.sqrt(nearest(x[at], 1, x)[0][:, 0]) if len(at) else np.full(len(x), NAN)
    kind = np.where(real[:, -1] < 0, 0.0, np.where(real[:, 0] > 0, 2.0, 1.0))  # attracts, both, repels
    return {"score": score, "basin_stability": basin, "separatrix_distance": apart, "kind": kind, "saddles": at}


def saddle_summary(x: np.ndarray) -> dict:
    keys = ("saddle_score_mean", "saddle_score_max", "saddle_score_current", "n_saddle_points", "saddle_fraction", "basin_stability_mean", "basin_stability_current", "separatrix_distance_current", "current_kind")
    if len(x) < x.shape[1] + 5:
        return dict.fromkeys(keys, NAN)
    r = saddle_points(x)
    s = r["score"]
    return dict(zip(keys, (float(np.nanmean(s)), float(np.nanmax(s)), float(s[-1]), float(len(r["saddles"])), len(r["saddles"]) / len(s), float(r["basin_stability"].mean()), float(r["basin_stability"][-1]), float(r["separatrix_distance"][-1]), float(r["kind"][-1])), strict=True))


def saddle(y) -> dict:
    """saddle_summary of a series embedded by its own delay and dimension; 100 samples and 50 points at least."""
    y = clean(y)
    none = saddle_summary(np.zeros((0, 2)))
    if len(y) < 100 or y.std() < 1e-12:
        return none | {"embedding_dim": NAN, "embedding_tau": NAN}
    tau = max(1, min(optimal_delay(y), len(y) // 10))
    dim = max(2, optimal_dimension(y, tau))
    x = embed(y, dim, tau)
    return (saddle_summary(x) if len(x) >= 50 else none) | {"embedding_dim": float(dim), "embedding_tau": float(tau)}


def stretch(point: np.ndarray, at: np.ndarray, after: np.ndarray, k: int = 10) -> float:
    """Growth rate at a place: log of the largest singular value of the linear map that takes the k nearest path points to
    their successors, both about their means; 0 with fewer than three."""
    j = np.argsort(((at - point) ** 2).sum(1), kind="stable")[:k]
    if len(j) < 3:
        return 0.0
    a, b = at[j] - at[j].mean(0), after[j] - after[j].mean(0)
    if np.sqrt((a * a).sum()) < 1e-12:
        return 0.0
    m = np.linalg.lstsq(a, b, rcond=None)[0]
    return 0.5 * math.log(max(float(np.linalg.eigvalsh(m.T @ m)[-1]), 1e-12))


def local_grid(a: np.ndarray, b: np.ndarray, along: int = 20, extent: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Places between and around two centres, along their axis and, in two or more dimensions, across it; and the axis."""
    mid, axis = (a + b) / 2, b - a
    size = float(np.sqrt(axis @ axis))
    if size < 1e-10:
        return mid[None], np.zeros(len(a))
    unit = axis / size
    t = np.linspace(-0.5 * extent, 0.5 * extent, along)
    if len(a) < 2:
        return mid + t[:, None] * size * unit, unit
    across = np.zeros(len(a))
    across[0 if abs(unit[0]) < 0.9 else 1] = 1
    across -= (across @ unit) * unit
    across /= np.sqrt(across @ across)
    s = np.linspace(-0.3, 0.3, max(3, along // 4))
    return (mid + (t[:, None, None] * unit + s[None, :, None] * across) * size).reshape(-1, len(a)), unit


def field_between(a: np.ndarray, b: np.ndarray, at: np.ndarray, after: np.ndarray) -> dict:
    """Growth over the grid between two centres: the ridge, its width at half height along the axis, the share of the grid
    under three tenths of it (the corridor), and the mean."""
    grid, unit = local_grid(a, b)
    f = np.array([stretch(p, at, after) for p in grid])
    top = float(f.max())
    high = (grid @ unit)[f >= top / 2]
    return {"ridge_strength": top, "ridge_width": float(np.ptp(high)) if len(high) > 1 else 0.0, "corridor_width": float((f < 0.3 * top).mean()), "mean_ftle": float(f.mean()), "n_grid": float(len(grid))}


def basin_depth(center: np.ndarray, at: np.ndarray, after: np.ndarray, rays: int = 8) -> dict:
    """Mean growth on three circles about a centre (in the first two dimensions), their radius the lower quartile of the
    paths' distances from it; and whether it is lower inside than outside (escape)."""
    d = np.sqrt(((at - center) ** 2).sum(1))
    radius = float(np.percentile(d, 25)) if len(d) else 1.0
    turn = np.linspace(0, 2 * np.pi, rays, endpoint=False)
    f = []
    for r in (0.5, 1.0, 1.5):
        p = np.tile(center, (rays, 1))
        p[:, 0] += r * radius * np.cos(turn)
        if len(center) > 1:
            p[:, 1] += r * radius * np.sin(turn)
        f.append([stretch(x, at, after) for x in p])
    f = np.array(f)
    real = f[f != 0]
    return {"basin_depth": float(real.mean()) if len(real) else NAN, "basin_radius": radius, "escape_rate": float(f[2].mean() - f[0].mean())}


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - 0.5 * beta_cdf(df / (df + mid * mid), df / 2, 0.5)
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2


# ---------------------------------------------------------------- views, fingerprints, copulas


def fourier_view(paths: np.ndarray) -> dict:
    """Median over columns of dominant frequency and flatness of each column's path; eight points at least."""
    if len(paths) < 8:
        return {"fourier_dominant_freq": NAN, "fourier_flatness": NAN}
    s = [spectral(p) for p in paths.T]
    return {"fourier_dominant_freq": float(np.nanmedian([x["dominant_freq"] for x in s])), "fourier_flatness": float(np.nanmedian([x["spectral_flatness"] for x in s]))}


def hilbert_view(paths: np.ndarray) -> dict:
    """Envelope of each column's path: mean, trend and variation, averaged."""
    if len(paths) < 4:
        return {"envelope_mean": NAN, "envelope_trend": NAN, "envelope_cv": NAN}
    e = np.stack([np.abs(analytic(p)) for p in paths.T], 1)
    m = e.mean(0)
    return {"envelope_mean": float(m.mean()), "envelope_trend": float(np.polyfit(np.arange(len(e)), e, 1)[0].mean()), "envelope_cv": float((e.std(0) / np.where(m < 1e-12, 1, m)).mean())}


def wavelet_view(paths: np.ndarray) -> dict:
    """Haar energies by scale of each column's path: commonest dominant scale, entropy (nats) and fine over coarse energy."""
    if len(paths) < 8:
        return {"wavelet_dominant_scale": NAN, "wavelet_entropy": NAN, "wavelet_ratio": NAN}
    rows = []
    for p in paths.T:
        x, energy = p - p.mean(), []
        while len(x) >= 2:
            x = x[: len(x) // 2 * 2]
            energy.append(float((((x[::2] - x[1::2]) / math.sqrt(2)) ** 2).sum()))
            x = (x[::2] + x[1::2]) / math.sqrt(2)
        e = np.array(energy)
        if e.sum() < 1e-20:
            rows.append((0.0, 0.0, NAN))
            continue
        q = e / e.sum()
        pos = q[q > 0]
        rows.append((float(e.argmax()), float(-(pos * np.log(pos)).sum()), float(e[0] / max(e[-1], 1e-12))))
    r = np.array(rows)
    with np.errstate(all="ignore"):
        ratio = r[:, 2][np.isfinite(r[:, 2])]
    return {"wavelet_dominant_scale": float(np.median(r[:, 0])), "wavelet_entropy": float(r[:, 1].mean()), "wavelet_ratio": float(np.median(ratio)) if len(ratio) else NAN}


def window_metrics(x: np.ndarray) -> dict:
    """Eighteen numbers of a signals x samples matrix: spectrum of its covariance (entropy in nats), correlation graph, distances
    to the centroid, level and movement."""
    n = len(x)
    lam = np.sort(np.maximum(np.linalg.eigvalsh(np.atleast_2d(np.cov(x))), 0))[::-1]
    t = lam.sum()
    q = lam / t if t > 0 else lam
    pos = q[q > 1e-12]
    with np.errstate(all="ignore"):
        c = np.nan_to_num(np.corrcoef(x)) if n > 1 else np.ones((1, 1))
    off = np.abs(c[np.triu_indices(n, 1)]) if n > 1 else np.zeros(1)
    g = laplacian_view(c.copy()) if n > 1 else {"algebraic_connectivity": 0.0, "spectral_gap": 0.0}
    center = x.mean(0)
    d = np.sqrt(((x - center) ** 2).sum(1))
    step = np.diff(center)
    return {
        "effective_dim": float(t * t / (lam @ lam)) if t > 0 else NAN, "total_variance": float(t), "eigenvalue_1": float(lam[0]), "eigenvalue_2": float(lam[1]) if n > 1 else 0.0, "eigenvalue_3": float(lam[2]) if n > 2 else 0.0,
        "eigenvalue_entropy": float(-(pos * np.log(pos)).sum()), "condition_number": float(lam[0] / max(lam[-1], 1e-12)), "ratio_2_1": float(lam[1] / max(lam[0], 1e-12)) if n > 1 else 0.0, "mean_abs_corr": float(off.mean()),
        "max_abs_corr": float(off.max()), "corr_std": float(off.std()), "algebraic_connectivity": g["algebraic_connectivity"], "spectral_gap": g["spectral_gap"], "mean_distance": float(d.mean()), "max_distance": float(d.max()),
        "std_distance": float(d.std()), "centroid_norm": float(np.sqrt((center * center).sum())), "centroid_speed": float(np.abs(step).mean()) if len(step) else 0.0,
    }


def _debye(t: float) -> float:
    s = np.linspace(1e-6, t, 100)
    return float(np.trapezoid(s / np.expm1(s), s) / t)


def frank_theta(tau: float) -> float:
    """Bisection on tau = 1 - 4 (1 - D1(theta)) / theta."""
    if abs(tau) < 1e-6:
        return 0.0
    lo, hi = 1e-4, 60.0
    f = lambda th: 1 - 4 / th * (1 - _debye(th)) - abs(tau)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return math.copysign((lo + hi) / 2, tau)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """By bisection on the normal distribution function: slow, sure, vectorised."""
    lo, hi = np.full(p.shape, -9.0), np.full(p.shape, 9.0)
    erf = np.vectorize(math.erf)
    for _ in range(45):
        mid = (lo + hi) / 2
        low = 0.5 * (1 + erf(mid / math.sqrt(2))) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def inversions(p: np.ndarray) -> int:
    """Pairs out of order in a permutation of 0..n-1, a bit of the values at a time."""
    p, total = np.asarray(p, np.int64), 0
    for b in range(len(p).bit_length() - 1, -1, -1):
        # places are grouped by the higher bits, in their first order within
        high, bit = p >> (b + 1), (p >> b) & 1
        ones = np.cumsum(bit)
        first = np.searchsorted(high, high)
        total += int(((ones - ones[first] + bit[first]) * (1 - bit)).sum())
        p = p[np.argsort(p >> b, kind="stable")]
    return total


def copula_fit(x, y) -> dict:
    """Kendall's tau, each family's parameter from it, and the family of least AIC with its tail dependence."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 10:
        return {"kendall": NAN, "aic": NAN, "lower": NAN, "upper": NAN, "family": NAN}
    along, up = np.argsort(x, kind="stable"), np.argsort(np.argsort(y, kind="stable"), kind="stable")
    u, v = (np.clip((r + 1) / (n + 1), 1e-6, 1 - 1e-6) for r in (np.argsort(along, kind="stable"), up))
    tau = 1 - 4 * inversions(up[along]) / (n * (n - 1))
    ll: list[tuple[float, float, float]] = []
    rho = math.sin(math.pi * tau / 2)
    a, b = normal_quantile(u), normal_quantile(v)
    r2 = max(1 - rho * rho, 1e-9)
    ll.append((float((-0.5 * math.log(r2) - (rho * rho * (a * a + b * b) - 2 * rho * a * b) / (2 * r2)).sum()), 0.0, 0.0))
    if 0 < tau < 1:
        th = 2 * tau / (1 - tau)
        s = u**-th + v**-th - 1
        ll.append((float((math.log1p(th) - (th + 1) * (np.log(u) + np.log(v)) - (2 + 1 / th) * np.log(s)).sum()), 2 ** (-1 / th), 0.0))
        g = 1 / (1 - tau)
        p, q = -np.log(u), -np.log(v)
        w = (p**g + q**g) ** (1 / g)
        ll.append((float((-w + (g - 1) * (np.log(p) + np.log(q)) - np.log(u) - np.log(v) + (1 - 2 * g) * np.log(w) + np.log(w + g - 1)).sum()), 0.0, 2 - 2 ** (1 / g)))
    else:
        ll += [(-math.inf, 0.0, 0.0)] * 2
    f = frank_theta(tau)
    if f:
        e = -np.expm1(-f)
        den = e - (-np.expm1(-f * u)) * (-np.expm1(-f * v))
        ll.append((float(np.log(np.maximum(f * e * np.exp(-f * (u + v)) / den**2, 1e-300)).sum()), 0.0, 0.0))
    else:
        ll.append((0.0, 0.0, 0.0))
    k = max(range(4), key=lambda i: ll[i][0])
    return {"kendall": tau, "aic": 2 - 2 * ll[k][0], "lower": ll[k][1], "upper": ll[k][2], "family": float(k)}


# ---------------------------------------------------------------- breaks


def _frames(y: np.ndarray, before: int, after: int) -> np.ndarray:
    """A row for each sample: its frame, NaN beyond the ends."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(before, NAN), y, np.full(after, NAN)]), before + after + 1)


def _middle(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first n of each sorted row."""
    row, half = np.arange(len(s)), n // 2
    lo, hi = s[row, np.maximum(half - 1, 0)], s[row, np.minimum(half, s.shape[1] - 1)]
    return np.where(n == 0, NAN, np.where(n % 2 == 1, hi, (lo + hi) / 2))


def spike_scores(y: np.ndarray, known: np.ndarray, sensitivity: float = 1.0, reach: int = 25, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Departure of each value from the median of the `reach` ones on each side over their 1.4826 MAD, and where it exceeds
    5 / sensitivity. Values not known are in no frame; NaN is above every number, as in Spark."""
    score, found = np.full(len(y), NAN), np.zeros(len(y), bool)
    wide = np.concatenate([np.full(reach, NAN), np.where(known, y, NAN), np.full(reach, NAN)])
    there = np.concatenate([np.zeros(reach, int), known, np.zeros(reach, int)])
    total = np.concatenate([[0], np.cumsum(there)])
    around = np.delete(np.arange(2 * reach + 1), reach)
    for a in range(0, len(y), block):
        at = np.arange(a, min(a + block, len(y)))
        n = total[at + 2 * reach + 1] - total[at] - known[at]
        frame = wide[at[:, None] + around]
        with np.errstate(invalid="ignore", divide="ignore"):
            m = _middle(np.sort(frame, axis=1), n)
            spread = _middle(np.sort(np.abs(frame - m[:, None]), axis=1), n)
            v = np.abs(y[at] - m) / (spread * 1.4826)
        score[at] = v
        found[at] = known[at] & (n > 0) & ~(spread < 1e-10) & ~(v <= 5 / sensitivity)
    return score, found


def alarm_sums(y: np.ndarray, noise: np.ndarray, sensitivity: float = 1.0, alpha: float = 0.05, slack: float = 0.5) -> list[tuple[int, float]]:
    """Places and sizes of the alarms: two-sided sums of departures from an exponential mean in units of noise, reset on alarm."""
    mean, up, down, limit, out = float(y[0]) if len(y) else 0.0, 0.0, 0.0, 4 / sensitivity, []
    for i, (v, q) in enumerate(zip(y.tolist(), noise.tolist(), strict=True)):
        z = (v - mean) / q
        up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
        if max(up, down) > limit:
            out.append((i, max(up, down)))
            mean, up, down = v, 0.0, 0.0
        else:
            mean = mean * (1 - alpha) + v * alpha
    return out


def break_scan(y: np.ndarray, sensitivity: float = 1.0, context: int = 50, spacing: int = 10, reach: int = 25, settle: int = 20, alpha: float = 0.05, slack: float = 0.5) -> list[dict]:
    """Breaks of one gap-free series: the same three detectors, merging and levels as the plan in operators.breaks."""
    n = len(y)
    if n < 2 * context + spacing:
        return []
    with np.errstate(all="ignore"):
        f = _frames(y, reach, reach - 1)
        noise = np.maximum(1.4826 * np.nanmedian(np.abs(f - np.nanmedian(f, 1)[:, None]), 1), 1e-10)
        score = np.zeros(n)
        d = np.concatenate([[0.0], np.abs(np.diff(y))]) / noise
        score = np.where(d > 5 / sensitivity, d, score)
        a = _frames(y, reach, reach).copy()
        a[:, reach] = NAN
        m = np.nanmedian(a, 1)
        spread = np.nanmedian(np.abs(a - m[:, None]), 1)
        s = np.abs(y - m) / (1.4826 * spread)
        score = np.where((spread >= 1e-10) & (s > 5 / sensitivity), np.maximum(score, s), score)
    for i, v in alarm_sums(y, noise, sensitivity, alpha, slack):
        score[i] = max(score[i], v)
    kept: list[int] = []
    for i in np.flatnonzero(score > 0).tolist():
        if not kept or i - kept[-1] >= spacing:
            kept.append(i)
        elif score[i] > score[kept[-1]]:
            kept[-1] = i
    out = []
    for i in kept:
        after = y[i + 1 : i + 1 + context]
        pre = float(np.median(y[max(0, i - context) : i])) if i else float(y[0])
        post = float(np.median(after)) if len(after) else float(y[i])
        step, impulse = post - pre, float(y[i]) - pre
        size = impulse if abs(impulse) > 2 * abs(step) else step
        calm = np.flatnonzero(np.abs(after[:settle] - post) < 2 * noise[i])
        took = int(calm[0]) + 1 if len(calm) else settle
        out.append({"r": i, "magnitude": abs(size), "direction": float(np.sign(size)), "sharpness": abs(size) / took, "duration": took, "pre_level": pre, "post_level": post, "snr": abs(size) / noise[i]})
    return out


def filled(y: np.ndarray) -> np.ndarray:
    """Missing values on the line between their neighbours; the ends take the nearest."""
    ok = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok]) if ok.any() else y[:0]
