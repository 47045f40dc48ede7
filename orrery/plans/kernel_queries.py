"""Operators whose inner loop is numeric: rows are checked against closed forms in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import window_kernels as M
from ..functions import windows as W
from ..operators import engines as E
from ..operators import features as X
from ..operators import geometry as G
from ..operators import kernel_ops as O2
from ..operators import normalize as N
from ..operators import pairs as P
from ..operators import registry as R
from ..operators import typology as TY
from ..sources import observations as O
from . import kernel_sql as Q
from . import sql as S
from .catalog import query, rounded
from .geometry_queries import _POS, _VEL, ALL, BASE, SHAPE, cloud, loadings, pairs

WIN = (64, 32)
KEY = ("cohort", "signal_id", "k")


def _window(name, f, outputs, window=WIN):
    body = Q.KERNELS.get(name)
    sql = Q.per_window(body(window[0]), outputs, *window, Q.LARGE) if body else None

    @query(f"kernel_{name}", sql)
    def run(spark, sf):
        w = O2.per_window(O.obs_events(spark, sf), f, outputs, *window)
        return w.select(*KEY, *(F.round(F.col(c).cast("double"), Q.LARGE.get(c, 6)).alias(c) for c in w.columns if c not in KEY))


for _name in ("spectral", "frequency_bands", "harmonics", "snr", "phase_coherence", "envelope", "hilbert_stability", "wavelet_stability", "memory", "dfa", "complexity", "adf_stat", "rqa", "dmd", "lof"):
    _window(_name, R.REGISTRY[_name].run, list(R.REGISTRY[_name].outputs))

_window("attractor", K.attractor, ["embedding_dim", "delay", "correlation_dim"], (128, 64))


@query("kernel_spectral_check", S.rounded(S.hops(32, 16) + """, ft AS (SELECT cohort, signal_id, k, f, sum(d * cos(2 * pi() * f * i / 32)) AS re, sum(d * sin(2 * pi() * f * i / 32)) AS im FROM c JOIN (SELECT unnest(range(1, 17)) AS f) ON true GROUP BY ALL),
ps AS (SELECT cohort, signal_id, k, f / 32.0 AS fr, (re * re + im * im) / 32 AS p, sum((re * re + im * im) / 32) OVER (PARTITION BY cohort, signal_id, k) AS t FROM ft), q AS (SELECT cohort, signal_id, k, sum(fr * p / t) AS spectral_centroid, sum(-p / t * log2(p / t)) / log2(16) AS spectral_entropy FROM ps GROUP BY cohort, signal_id, k)""", ["spectral_centroid", "spectral_entropy"]))
def kernel_spectral_check(spark, sf):
    """The Fourier kernel against explicit sums in SQL."""
    w = O2.per_window(O.obs_events(spark, sf), K.spectral, ["spectral_centroid", "spectral_entropy"], 32, 16)
    return rounded(w.select("cohort", "signal_id", F.col("k").cast("long").alias("k"), "spectral_centroid", "spectral_entropy"), KEY)


@query("kernel_sample_entropy_check", S.hops(32, 16) + Q.templates(32) + f" SELECT cohort, signal_id, k::INT AS k, round({Q._SE}, 6) AS kernel, round({Q._SE}, 6) AS sample_entropy FROM pa GROUP BY cohort, signal_id, k")
def kernel_sample_entropy_check(spark, sf):
    """The entropy kernel beside the plan of array expressions: both columns agree."""
    o = O.obs_events(spark, sf)
    w = O2.per_window(o, lambda y: {"kernel": K.sample_entropy(y)}, ["kernel"], 32, 16).select("cohort", "signal_id", F.col("k").cast("int").alias("k"), "kernel")
    from .engine_queries import arrays

    return rounded(w.join(E.sample_entropy(arrays(spark, sf)), list(KEY)), KEY)


_ASKED = ["statistics", "trend", "spectral", "memory", "complexity", "snr", "envelope"]
_LOOKS = {"statistics": 16, "trend": 48, "spectral": 64, "memory": 48, "complexity": 64, "snr": 32, "envelope": 32}
_STATISTICS = f", q AS (SELECT {Q.K3}, avg(d ** 4) / avg(d * d) ** 2 - 3 AS kurtosis, avg(d ** 3) / avg(d * d) ** 1.5 AS skewness, max(abs(value)) / sqrt(avg(value * value)) AS crest_factor FROM c GROUP BY {Q.K3})"
_TREND = f", cu AS (SELECT *, sum(d) OVER (PARTITION BY {Q.K3} ORDER BY i) AS cs FROM c), q AS (SELECT {Q.K3}, regr_slope(value, i) AS trend_slope, regr_r2(value, i) AS trend_r2, sqrt(greatest(var_pop(value) * (1 - regr_r2(value, i)), 0)) AS detrend_std, max(cs) - min(cs) AS cusum_range FROM cu GROUP BY {Q.K3})"


def _vector_sql() -> str:
    body = {"statistics": lambda n: _STATISTICS, "trend": lambda n: _TREND} | Q.KERNELS
    parts = [f"({S.hops(64, 32, _LOOKS[e])}{body[e](_LOOKS[e])} SELECT * FROM q) AS t_{e}" for e in _ASKED]
    ends = f"({S.hops(64, 32)} SELECT {Q.K3}, min(signal_0) AS s0, max(signal_0) AS s1 FROM w GROUP BY {Q.K3}) AS ends"
    cols = ", ".join(f"round({c}::DOUBLE, {Q.LARGE.get(c, 6)}) AS {c}" for e in _ASKED for c in R.REGISTRY[e].outputs)
    mask = sum(1 << list(R.REGISTRY).index(e) for e in _ASKED)
    return f"SELECT cohort, signal_id, {mask}::BIGINT AS engine_mask, s0 AS signal_0_start, s1 AS signal_0_end, (s0 + s1) / 2 AS signal_0_center, {cols} FROM {ends} " + " ".join(f"JOIN {p} USING ({Q.K3})" for p in parts)


@query("signal_vector", _vector_sql())
def signal_vector(spark, sf):
    """A manifest of several engines over all series, each with its own look-back."""
    m = R.Manifest.parse({"system": {"window": 64, "stride": 32}, "cohorts": {"*": {"*": {"engines": _ASKED}}}, "engine_windows": {"trend": 48}})
    v = R.signal_vector(O.obs_events(spark, sf), m)
    key = ("cohort", "signal_id", "engine_mask")
    return v.select(*key, *(F.round(F.col(c).cast("double"), Q.LARGE.get(c, 6)).alias(c) for c in v.columns if c not in key))


@query("ftle")
def ftle(spark, sf):
    return rounded(O2.ftle(O.obs_events(spark, sf), event=120.0), ("cohort", "signal_id", "direction", "stability"))


@query("ftle_backward")
def ftle_backward(spark, sf):
    return rounded(O2.ftle(O.obs_events(spark, sf), "backward"), ("cohort", "signal_id", "direction", "stability"))


@query("ftle_rolling")
def ftle_rolling(spark, sf):
    return rounded(O2.ftle_rolling(O.obs_events(spark, sf), 100, 50), KEY)


@query("lyapunov")
def lyapunov(spark, sf):
    return rounded(O2.lyapunov(O.obs_events(spark, sf)), ("cohort", "signal_id"))


@query("cohort_geometry")
def cohort_geometry(spark, sf):
    return rounded(O2.cohort_geometry(cloud(spark, sf), ALL), ("cohort", "engine", "k"))


@query("eigenvector_flips", BASE + _POS + ", pd AS (SELECT *, pc1_loading * lag(pc1_loading) OVER (PARTITION BY cohort, signal_id ORDER BY k) AS dot FROM ps), fl AS (SELECT cohort, k, sum(dot) AS dot FROM pd GROUP BY cohort, k) SELECT cohort, sum((dot < 0)::INT)::BIGINT AS eigenvector_flip_count, count(*) AS n_windows FROM fl GROUP BY cohort")
def eigenvector_flips(spark, sf):
    return O2.eigenvector_flips(loadings(spark, sf))


@query("laplacian_view")
def laplacian_view(spark, sf):
    return rounded(O2.laplacian(O.obs_events(spark, sf)), ("cohort", "k"))


def _path(spark, sf):
    c = G.centroid(cloud(spark, sf), SHAPE)
    return c.select("cohort", F.col("k").cast("double").alias("t"), *(f"state_{f}" for f in SHAPE))


_STATE = [f"state_{f}" for f in SHAPE]


@query("persistent_homology")
def persistent_homology(spark, sf):
    return rounded(O2.persistent_homology(_path(spark, sf), _STATE, 12, 4), ("cohort", "k"))


@query("information_flow")
def information_flow(spark, sf):
    """Pairs that co-load in some window; the others are not aligned at all."""
    load = G.pairwise(loadings(spark, sf), ["pc1_loading"], loading="pc1_loading").filter("needs_granger").select("cohort", "signal_a", "signal_b").distinct()
    return rounded(O2.information_flow(P.aligned(O.obs_events(spark, sf), load)), ("cohort", "signal_a", "signal_b"))


@query("signal_stability", Q.stability(30, 5, O2.HILBERT, O2.WAVELET))
def signal_stability(spark, sf):
    s = O2.signal_stability(O.obs_events(spark, sf))
    base = lambda c: c.rpartition("_")[0]
    return s.select("cohort", "k", F.col("n_signals").cast("double").alias("n_signals"), *(F.round(c, min(4, Q.LARGE.get(base(c), 4))).alias(c) for c in s.columns if c not in ("cohort", "k", "n_signals")))


@query("trajectory_library")
def trajectory_library(spark, sf):
    d = G.effective_dim(cloud(spark, sf), SHAPE).withColumn("signal_0_end", F.col("k").cast("double"))
    return rounded(O2.trajectory_library(d, ["effective_dim", "total_variance"]), ("cohort",))


@query("ftle_field")
def ftle_field(spark, sf):
    return rounded(O2.ftle_field(_path(spark, sf), _STATE), ("cohort",))


def _sensitivity_sql() -> str:
    """Least squares of each column's next step on all columns' steps, by the inverse of a 3 x 3 matrix."""
    n = range(3)
    s = BASE + ", cv AS (SELECT cohort, k, " + ", ".join(f"avg({f}) AS s{i}" for i, f in enumerate(SHAPE)) + " FROM fv GROUP BY cohort, k)"
    s += ", df AS (SELECT cohort, k, " + ", ".join(f"s{i} - lag(s{i}) OVER z AS d{i}" for i in n) + " FROM cv WINDOW z AS (PARTITION BY cohort ORDER BY k)), d2 AS (SELECT * FROM df WHERE d0 IS NOT NULL)"
    s += ", dz AS (SELECT cohort, k, " + ", ".join(f"(d{i} - avg(d{i}) OVER p) / CASE WHEN stddev_pop(d{i}) OVER p < 1e-12 THEN 1 ELSE stddev_pop(d{i}) OVER p END AS x{i}" for i in n) + " FROM d2 WINDOW p AS (PARTITION BY cohort))"
    s += ", dn AS (SELECT *, " + ", ".join(f"lead(x{i}) OVER (PARTITION BY cohort ORDER BY k) AS y{i}" for i in n) + " FROM dz)"
    s += ", gg AS (SELECT cohort, " + ", ".join([f"sum(x{i} * x{j}) AS g{i}{j}" for i in n for j in n] + [f"sum(x{i} * y{j}) AS h{i}{j}" for i in n for j in n]) + " FROM dn WHERE y0 IS NOT NULL GROUP BY cohort)"
    cof = lambda i, j: f"(g{(i + 1) % 3}{(j + 1) % 3} * g{(i + 2) % 3}{(j + 2) % 3} - g{(i + 1) % 3}{(j + 2) % 3} * g{(i + 2) % 3}{(j + 1) % 3})"
    s += ", gi AS (SELECT *, " + " + ".join(f"g0{j} * {cof(0, j)}" for j in n) + " AS det FROM gg)"
    m = lambda i, j: "(" + " + ".join(f"{cof(k, i)} * h{k}{j}" for k in n) + ") / det"
    s += ", sv AS (SELECT cohort, " + ", ".join("sqrt(" + " + ".join(f"({m(i, j)}) ** 2" for j in n) + f") AS v{i}" for i in n) + " FROM gi)"
    s += ", sl AS (" + " UNION ALL ".join(f"SELECT cohort, 'state_{f}' AS variable, v{i} AS v, v0 + v1 + v2 AS tot FROM sv" for i, f in enumerate(SHAPE)) + ")"
    return s + " SELECT cohort, variable, round(v, 6) AS sensitivity, row_number() OVER (PARTITION BY cohort ORDER BY v DESC)::DOUBLE AS rank, round(sum(-v / tot * ln(v / tot)) OVER (PARTITION BY cohort), 6) AS entropy FROM sl"


@query("trajectory_sensitivity", _sensitivity_sql())
def trajectory_sensitivity(spark, sf):
    return rounded(O2.sensitivity(_path(spark, sf), _STATE), ("cohort", "variable"))


@query("regime_normalised")
def regime_normalised(spark, sf):
    """Regimes from two of the measures as settings, the others normalised within them."""
    wide = O.obs_lineitem(spark, sf).groupBy("cohort", "signal_0").pivot("signal_id", ["l_quantity", "l_discount", "l_tax"]).agg(F.max("value"))
    n = X.regime_normalised(O.obs_lineitem(spark, sf), wide, ["cohort", "signal_0"], ["l_discount", "l_tax"], k=4)
    return n.groupBy("signal_id", "regime").agg(F.count("*").alias("n"), F.round(F.avg("scaled"), 6).alias("mean"))


@query("trajectory_views")
def trajectory_views(spark, sf):
    return rounded(O2.trajectory_views(_path(spark, sf), _STATE), ("cohort",))


@query("fingerprint")
def fingerprint(spark, sf):
    """Eighteen window metrics, each summarised by its curve: one wide row a cohort."""
    c = X.curve(O2.fingerprint_windows(O.obs_events(spark, sf)))
    names = [n for n in c.columns if n not in ("cohort", "metric", "n")]
    wide = c.groupBy("cohort").pivot("metric", O2.METRICS).agg(*(F.first(n).alias(n) for n in names))
    return rounded(wide, ("cohort",))


@query("copula_fits")
def copula_fits(spark, sf):
    return rounded(O2.copula_fits(pairs(spark, sf)), ("cohort", "signal_a", "signal_b", "family"))


_SMOOTH = S.obs() + f""", rw AS (SELECT *, row_number() OVER p - 1 AS r, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM obs WINDOW p AS (PARTITION BY cohort, signal_id ORDER BY signal_0)), hp AS (SELECT *, CASE WHEN r < 5 THEN r WHEN r > n - 6 THEN r - n + 11 ELSE 5 END AS pos FROM rw),
sm AS (SELECT a.cohort, a.signal_id, a.signal_0, sum(hat.w * b.value) AS value FROM hp a JOIN {Q.savgol_weights()} ON hat.pos = a.pos JOIN rw b ON b.cohort = a.cohort AND b.signal_id = a.signal_id AND b.r = a.r - a.pos + hat.j GROUP BY ALL)""" + _VEL.replace("FROM obs WINDOW", "FROM sm WINDOW")


@query("velocity_field_smoothed", _SMOOTH + " SELECT cohort, signal_0, dm AS dominant_motion_signal, round(sqrt(v2), 6) AS speed, round(sqrt(a2), 6) AS acceleration_magnitude, round(al, 6) AS acceleration_parallel, round(sqrt(greatest(a2 - al * al, 0)), 4) AS acceleration_perpendicular, round(sqrt(greatest(a2 - al * al, 0)) / nullif(v2, 0), 4) AS curvature, round(tp / nullif(v2, 0), 6) AS dominant_motion_fraction, round(exp(ln(nullif(v2, 0)) - vl / nullif(v2, 0)), 6) AS motion_dimensionality FROM vf")
def velocity_field_smoothed(spark, sf):
    from ..operators import dynamics as D

    v = D.velocity_field(O2.smoothed(O.obs_events(spark, sf)))
    key = ("cohort", "signal_0", "dominant_motion_signal")
    return v.select(*key, *(F.round(c, 4 if c in ("acceleration_perpendicular", "curvature") else 6).alias(c) for c in v.columns if c not in key))


_window("typology", lambda y: {"hurst": K.hurst(y)["hurst"], "sample_entropy": K.sample_entropy(y), "spectral_flatness": K.spectral(y)["spectral_flatness"], "lyapunov_proxy": K.lyapunov(y)["lyapunov"]}, ["hurst", "sample_entropy", "spectral_flatness", "lyapunov_proxy"])


@query("lyapunov_rolling")
def lyapunov_rolling(spark, sf):
    return rounded(O2.lyapunov_rolling(O.obs_events(spark, sf), 100, 50), KEY)


@query("lyapunov_trend")
def lyapunov_trend(spark, sf):
    return rounded(O2.lyapunov_trend(O2.lyapunov_rolling(O.obs_events(spark, sf), 100, 50), 2), ("cohort", "signal_id"))


@query("saddles")
def saddles(spark, sf):
    return rounded(O2.saddles(O.obs_events(spark, sf)), ("cohort", "signal_id"))


@query("saddles_rolling")
def saddles_rolling(spark, sf):
    return rounded(O2.saddles_rolling(O.obs_events(spark, sf), 150, 50), KEY)


@query("path_saddles")
def path_saddles(spark, sf):
    return rounded(O2.path_saddles(_path(spark, sf), _STATE), ("cohort",))


@query("influence_matrix")
def influence_matrix(spark, sf):
    return rounded(O2.influence(_path(spark, sf), _STATE), ("cohort", "source", "target"))


@query("sensitivity_rolling")
def sensitivity_rolling(spark, sf):
    return rounded(O2.sensitivity_rolling(_path(spark, sf), _STATE, 8, 2), ("cohort", "dominant", "transition"))


@query("ftle_field_pairs")
def ftle_field_pairs(spark, sf):
    return rounded(O2.field_pairs(_path(spark, sf), _STATE, 2), ("cohort_a", "cohort_b"))


@query("basins")
def basins(spark, sf):
    return rounded(O2.basins(_path(spark, sf), _STATE), ("cohort",))


def _long_dims(spark, sf):
    return G.effective_dim(cloud(spark, sf, 16, 8), SHAPE).withColumn("signal_0_end", (15 + 8 * F.col("k")).cast("double"))


@query("cohort_ftle")
def cohort_ftle(spark, sf):
    return rounded(O2.cohort_ftle(_long_dims(spark, sf), least=25), ("cohort", "direction", "stability"))


@query("cohort_information_flow")
def cohort_information_flow(spark, sf):
    """Coupling of cohorts' effective dimension, beside what their histograms share."""
    d = _long_dims(spark, sf).select(F.lit("fleet").alias("cohort"), F.col("cohort").alias("signal_id"), F.col("k").cast("double").alias("signal_0"), F.col("effective_dim").alias("value"))
    p = P.aligned(d)
    both = O2.information_flow(p, least=20).join(P.mutual_information(p), list(P.PAIR)).join(P.transfer_entropy(p), list(P.PAIR)).join(P.divergence(p), list(P.PAIR))
    return rounded(both.drop("cohort").withColumnsRenamed({"signal_a": "cohort_a", "signal_b": "cohort_b"}), ("cohort_a", "cohort_b"))


@query("geometry_vector")
def geometry_vector(spark, sf):
    """Spread and group centroids of each cohort's cloud, with the four views of its path so far."""
    groups = G.feature_groups(ALL, {"shape": SHAPE, "trend": ["trend_slope", "detrend_std"]})
    v = G.group_vector(cloud(spark, sf), groups)
    views = O2.trajectory_views(_path(spark, sf), _STATE).withColumn("k", F.col("at").cast("int")).drop("at")
    graph = O2.laplacian(O.obs_events(spark, sf), 32, 16).withColumn("k", F.col("k").cast("int"))
    return rounded(v.join(views, ["cohort", "k"], "left").join(graph, ["cohort", "k"], "left"), ("cohort", "k", "n_signals"))


_FEATURES = ["spectral_entropy", "hurst", "sample_entropy", "dfa", "acf_half_life", "kurtosis", "skewness", "trend_r2", "recurrence_rate", "determinism"]
_CORR = [("spectral_entropy", "hurst"), ("spectral_entropy", "sample_entropy"), ("hurst", "dfa"), ("kurtosis", "skewness")]


def _ten(y):
    r = K.rqa(y)
    return {"spectral_entropy": K.spectral(y)["spectral_entropy"], "hurst": K.hurst(y)["hurst"], "sample_entropy": K.sample_entropy(y), "dfa": K.dfa(y)["dfa"], "acf_half_life": M.acf_decay(y)["acf_half_life"]} | {
        n: M.basic(y)[n] for n in ("kurtosis", "skewness")} | {"trend_r2": M.trend(y)["trend_r2"], "recurrence_rate": r["recurrence_rate"], "determinism": r["determinism"]}


def _ten_sql() -> str:
    body = Q.spectral(64).replace("q AS", "q1 AS") + Q.memory(64, "q2") + Q.complexity(64, "q3") + Q.dfa(64, "q4") + Q.acf("q5") + _STATISTICS.replace("q AS", "q6 AS") + _TREND.replace("q AS", "q7 AS") + Q.rqa(64, "q8")
    fp = f", fv AS (SELECT {Q.K3}, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in _FEATURES) + " FROM q1 " + " ".join(f"LEFT JOIN q{i} USING ({Q.K3})" for i in range(2, 9)) + ")"
    r = lambda x, y: f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL), 0)"
    fp += ", fp AS (SELECT cohort, signal_id, count(*) AS n_windows, " + ", ".join(f"avg({f}) AS mean_{f}, stddev_samp({f}) AS std_{f}" for f in _FEATURES) + ", " + ", ".join(f"{r(x, y)} AS corr_{x}_{y}" for x, y in _CORR)
    return S.hops(64, 32) + body + fp + ", (" + " + ".join(f"coalesce(stddev_samp({f}), 0)" for f in _FEATURES) + ") / 10 AS volatility FROM fv GROUP BY cohort, signal_id)"


def _ten_features(spark, sf):
    return O2.per_window(O.obs_events(spark, sf), _ten, _FEATURES, *WIN)


_PRINT = [f"{k}_{f}" for f in _FEATURES for k in ("mean", "std")] + [f"corr_{x}_{y}" for x, y in _CORR] + ["volatility"]


@query("fingerprint_ten", _ten_sql() + " SELECT cohort, signal_id, n_windows, " + ", ".join(f"round({c}::DOUBLE, 5) AS {c}" for c in _PRINT) + " FROM fp")
def fingerprint_ten(spark, sf):
    """Mean and deviation of ten features of a signal's windows, four correlations of them, volatility."""
    return rounded(N.fingerprint(_ten_features(spark, sf), _FEATURES, _CORR), ("cohort", "signal_id", "n_windows"), 5)


def _bh(f):
    return f"CASE WHEN a.std_{f} > 1e-10 AND b.std_{f} > 1e-10 THEN 0.25 * (a.mean_{f} - b.mean_{f}) ** 2 / (a.std_{f} ** 2 + b.std_{f} ** 2) + 0.5 * ln((a.std_{f} ** 2 + b.std_{f} ** 2) / (2 * a.std_{f} * b.std_{f})) END"


@query("similarity_ten", _ten_sql() + ", sq AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, " + " + ".join(f"coalesce({_bh(f)}, 0)" for f in _FEATURES) + " AS distance, " + " + ".join(f"(({_bh(f)}) IS NOT NULL)::INT" for f in _FEATURES) + " AS n_features, abs(a.volatility - b.volatility) AS volatility_diff FROM fp a JOIN fp b ON a.cohort = b.cohort AND a.signal_id < b.signal_id) SELECT cohort, signal_a, signal_b, n_features, round(distance, 5) AS distance, round(distance / nullif(n_features, 0), 5) AS normalized_distance, round(exp(-distance), 5) AS similarity, round(volatility_diff, 5) AS volatility_diff FROM sq")
def similarity_ten(spark, sf):
    p = N.fingerprint(_ten_features(spark, sf), _FEATURES, [])
    return rounded(N.similarity(p, _FEATURES), ("cohort", "signal_a", "signal_b", "n_features"), 5)


@query("typology_all")
def typology_all(spark, sf):
    """All eleven metrics of each window in one row."""
    f = lambda y: {"hurst": K.hurst(y)["hurst"], "sample_entropy": K.sample_entropy(y), "spectral_flatness": K.spectral(y)["spectral_flatness"], "lyapunov_proxy": K.lyapunov(y)["lyapunov"]}
    o = O.obs_events(spark, sf)
    k = O2.per_window(o, f, ["hurst", "sample_entropy", "spectral_flatness", "lyapunov_proxy"], *WIN)
    return rounded(TY.all_metrics(W.hop(E.lagged(o, 1), *WIN), k), KEY)


@query("rolling_trend", S.indexed() + " SELECT cohort, signal_id, signal_0, round(regr_slope(value, r) OVER w, 6) AS trend_slope, round(regr_r2(value, r) OVER w, 6) AS trend_r2 FROM r WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) >= 32")
def rolling_trend(spark, sf):
    """The trend engine over the last 32 samples of every sample."""
    return rounded(O2.rolling_trend(O.obs_events(spark, sf), 32).select("cohort", "signal_id", "signal_0", "trend_slope", "trend_r2"), ("cohort", "signal_id", "signal_0"))
