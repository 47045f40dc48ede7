"""Clouds of window features, their dynamics, wide motion, early warning, pairs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import windows as W
from ..operators import dynamics as D
from ..operators import engines as E
from ..operators import geometry as G
from ..operators import pairs as P
from ..sources import observations as O
from . import sql as S
from .catalog import query, rounded
from .signal_queries import r6

SHAPE = ["kurtosis", "skewness", "crest_factor"]
ALL = ["kurtosis", "skewness", "crest_factor", "trend_slope", "detrend_std"]
CK = ("cohort", "k")


def cloud_sql(w: int, s: int, view: str = "events") -> str:
    return S.hops(w, s, view=view) + ", fv AS (SELECT cohort, signal_id, k, avg(d ** 4) / nullif(avg(d * d) ** 2, 0) - 3 AS kurtosis, avg(d ** 3) / nullif(avg(d * d) ** 1.5, 0) AS skewness, max(abs(value)) / nullif(sqrt(avg(value * value)), 0) AS crest_factor, regr_slope(value, i) AS trend_slope, sqrt(greatest(var_pop(value) * (1 - regr_r2(value, i)), 0)) AS detrend_std FROM c GROUP BY cohort, signal_id, k)"


def cloud(spark, sf, w=32, s=16, obs=O.obs_events):
    rows = W.hop(W.indexed(obs(spark, sf)), w, s)
    return E.statistics(rows).join(E.trend(rows).select(*E.KEYS, "trend_slope", "detrend_std"), list(E.KEYS))


def _r(a, b):
    return f"CASE WHEN stddev_pop({a}) < 1e-10 OR stddev_pop({b}) < 1e-10 THEN 0 ELSE " + ("1" if a == b else f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)") + " END"


def dim_sql(features, keys="cohort, k"):
    tr = " + ".join(f"({_r(f, f)})" for f in features)
    nm = " + ".join(f"({_r(f, f)}) ** 2" for f in features) + " + " + " + ".join(f"2 * ({_r(a, b)}) ** 2" for a, b in itertools.combinations(features, 2))
    return f", ed AS (SELECT {keys}, count(*) AS n_signals, ({tr}) AS tr, ({nm}) AS nm FROM fv GROUP BY {keys} HAVING count(*) >= 2), ee AS (SELECT *, tr * tr / nullif(nm, 0) AS effective_dim, tr * n_signals / (n_signals - 1) AS total_variance FROM ed)"


@query("flagship_effective_dim", cloud_sql(16, 8) + dim_sql(SHAPE) + " SELECT cohort, k, n_signals, 3 AS n_features, round(effective_dim, 6) AS effective_dim, round(total_variance, 6) AS total_variance FROM ee")
def flagship_effective_dim(spark, sf):
    """Windows, shape engines, z-scored correlation and its participation ratio: one exchange by series, one by cohort window."""
    rows = W.hop(W.indexed(O.obs_events(spark, sf)), 16, 8)
    d = G.effective_dim(E.statistics(rows), SHAPE)
    return d.select("cohort", "k", "n_signals", "n_features", F.round("effective_dim", 6).alias("effective_dim"), F.round("total_variance", 6).alias("total_variance"))


BASE = cloud_sql(32, 16)


@query("cohort_geometry_core", BASE + dim_sql(ALL) + " SELECT cohort, k, n_signals, 5 AS n_features, round(effective_dim, 6) AS effective_dim, round(total_variance, 6) AS total_variance FROM ee")
def cohort_geometry_core(spark, sf):
    return rounded(G.effective_dim(cloud(spark, sf), ALL), (*CK, "n_signals", "n_features"))


_CEN = ", cc AS (SELECT *, " + ", ".join(f"avg({f}) OVER p AS c_{f}" for f in ALL) + " FROM fv WINDOW p AS (PARTITION BY cohort, k)), dd AS (SELECT *, sqrt(" + " + ".join(f"({f} - c_{f}) ** 2" for f in ALL) + ") AS dist FROM cc)"


@query("cohort_vector_centroid", BASE + _CEN + " SELECT cohort, k, count(*) AS n_signals, " + ", ".join(f"round(any_value(c_{f}), 6) AS state_{f}" for f in ALL) + ", round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance, round(stddev_pop(dist), 6) AS std_distance FROM dd GROUP BY cohort, k")
def cohort_vector_centroid(spark, sf):
    return rounded(G.centroid(cloud(spark, sf), ALL), (*CK, "n_signals"))


@query("weighted_centroid", BASE + " SELECT cohort, k, count(*) AS n_signals, " + ", ".join(f"round(sum(detrend_std * {f}) / sum(detrend_std), 6) AS state_{f}" for f in SHAPE) + " FROM fv GROUP BY cohort, k")
def weighted_centroid(spark, sf):
    return rounded(G.centroid(cloud(spark, sf), SHAPE, weight="detrend_std").drop("mean_distance", "max_distance", "std_distance"), (*CK, "n_signals"))


_EIG = f""", rr AS (SELECT cohort, k, count(*) AS n_signals, {_r('kurtosis', 'skewness')} AS a, {_r('kurtosis', 'crest_factor')} AS b, {_r('skewness', 'crest_factor')} AS g FROM fv GROUP BY cohort, k HAVING count(*) >= 3),
pp AS (SELECT *, sqrt((a * a + b * b + g * g) / 3) AS p FROM rr), ph AS (SELECT *, acos(least(greatest(a * b * g / (p * p * p), -1), 1)) / 3 AS phi FROM pp),
ll AS (SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 + 2 * p * cos(phi + 2.0943951023931953) AS l3 FROM ph), l2 AS (SELECT *, 3 - l1 - l3 AS l2 FROM ll),
vv AS (SELECT *, a * g - b * (1 - l1) AS v1, b * a - (1 - l1) * g AS v2, (1 - l1) ** 2 - a * a AS v3 FROM l2),
sg AS (SELECT *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) AS vn, sign(CASE WHEN abs(v1) = greatest(abs(v1), abs(v2), abs(v3)) THEN v1 WHEN abs(v2) = greatest(abs(v1), abs(v2), abs(v3)) THEN v2 ELSE v3 END) AS s FROM vv)"""


@query("cohort_spectrum3", BASE + _EIG + """ SELECT cohort, k, n_signals, round(l1 * n_signals / (n_signals - 1), 6) AS eigenvalue_1, round(l2 * n_signals / (n_signals - 1), 6) AS eigenvalue_2, round(l3 * n_signals / (n_signals - 1), 6) AS eigenvalue_3, round(l1 / 3, 6) AS explained_1,
round((SELECT sum(CASE WHEN x > 1e-12 THEN -x * log2(x) ELSE 0 END) FROM (SELECT unnest([greatest(l1, 0) / 3, greatest(l2, 0) / 3, greatest(l3, 0) / 3]) AS x)), 6) AS eigenvalue_entropy, round(l2 / l1, 6) AS ratio_2_1, round(l3 / l1, 6) AS ratio_3_1, round(s * v1 / vn, 6) AS pc_1, round(s * v2 / vn, 6) AS pc_2, round(s * v3 / vn, 6) AS pc_3 FROM sg""")
def cohort_spectrum3(spark, sf):
    """Eigenvalues and leading axis of the shape features in closed form."""
    return rounded(G.eigen3(cloud(spark, sf), SHAPE).drop("eigenvalue_entropy_norm", "condition_number"), (*CK, "n_signals"))


_POS = _EIG + ", z AS (SELECT fv.*, " + ", ".join(f"({f} - avg({f}) OVER p) / stddev_pop({f}) OVER p AS z{i}" for i, f in enumerate(SHAPE)) + " FROM fv WINDOW p AS (PARTITION BY cohort, k)), ps AS (SELECT z.cohort, z.k, signal_id, (z0 * v1 + z1 * v2 + z2 * v3) * s / vn AS pc1_loading FROM z JOIN sg USING (cohort, k))"


def loadings(spark, sf):
    c = cloud(spark, sf)
    return G.positions(c, G.eigen3(c, SHAPE), SHAPE)


@query("cohort_signal_positions", BASE + _POS + " SELECT cohort, k, signal_id, round(pc1_loading, 5) AS pc1_loading FROM ps")
def cohort_signal_positions(spark, sf):
    return rounded(loadings(spark, sf), (*CK, "signal_id"), 5)


@query("signal_dominance", BASE + _POS + """, en AS (SELECT *, CASE WHEN cohort < 'd' THEN 'shape_a' ELSE 'shape_b' END AS engine FROM ps),
pe AS (SELECT engine, signal_id, avg(abs(pc1_loading)) AS mean_abs, arg_max(abs(pc1_loading), (k, cohort)) AS fin, sign(avg(pc1_loading)) AS sg, count(*) AS nw FROM en GROUP BY ALL),
ag AS (SELECT 'aggregate' AS engine, signal_id, avg(mean_abs) AS mean_abs, arg_max(fin, (nw, engine)) AS fin, arg_max(sg, (nw, engine)) AS sg, sum(nw) AS nw FROM pe GROUP BY signal_id), un AS (SELECT * FROM pe UNION ALL SELECT * FROM ag)
SELECT engine, signal_id, round(mean_abs, 6) AS mean_abs_pc1_loading, round(fin, 5) AS final_abs_pc1_loading, row_number() OVER (PARTITION BY engine ORDER BY mean_abs DESC, signal_id)::INT AS dominance_rank, sg::INT AS pc1_loading_sign, nw::INT AS n_windows FROM un""")
def signal_dominance(spark, sf):
    ld = loadings(spark, sf).withColumn("engine", F.when(F.col("cohort") < "d", "shape_a").otherwise("shape_b"))
    d = G.dominance(ld)
    return d.select("engine", "signal_id", F.round("mean_abs_pc1_loading", 6).alias("mean_abs_pc1_loading"), F.round("final_abs_pc1_loading", 5).alias("final_abs_pc1_loading"), "dominance_rank", F.col("pc1_loading_sign").cast("int").alias("pc1_loading_sign"), "n_windows")


_GEO = ", ge AS (SELECT *, (" + " + ".join(f"{f} * c_{f}" for f in ALL) + ") / sqrt(" + " + ".join(f"c_{f} ** 2" for f in ALL) + ") AS al, sqrt(" + " + ".join(f"{f} ** 2" for f in ALL) + ") AS mg FROM dd)"


@query("signal_geometry_dist", BASE + _CEN + _GEO + " SELECT cohort, k, signal_id, round(dist, 6) AS distance, round(al, 6) AS contribution, round(sqrt(greatest(mg * mg - al * al, 0)), 5) AS residual, round(mg, 6) AS magnitude FROM ge")
def signal_geometry_dist(spark, sf):
    g = G.signal_geometry(cloud(spark, sf), ALL)
    return rounded(g.drop("residual"), (*CK, "signal_id")).join(rounded(g.select(*CK, "signal_id", "residual"), (*CK, "signal_id"), 5), [*CK, "signal_id"])


def _pair_sql(src, keys, member, features):
    d = lambda t, u: " + ".join(f"{t}.{f} * {u}.{f}" for f in features)
    s = lambda t: " + ".join(f"{t}.{f}" for f in features)
    n, short = len(features), member.removesuffix("_id")
    return f", pq AS (SELECT {', '.join('a.' + k for k in keys)}, a.{member} AS {short}_a, b.{member} AS {short}_b, sqrt({' + '.join(f'(a.{f} - b.{f}) ** 2' for f in features)}) AS distance, {d('a', 'b')} AS ab, {d('a', 'a')} AS aa, {d('b', 'b')} AS bb, {s('a')} AS sa, {s('b')} AS sb FROM {src} a JOIN {src} b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} AND a.{member} < b.{member}) SELECT {', '.join(keys)}, {short}_a, {short}_b, round(distance, 6) AS distance, round(ab / sqrt(aa * bb), 6) AS cosine_similarity, round((ab - sa * sb / {n}) / sqrt((aa - sa * sa / {n}) * (bb - sb * sb / {n})), 5) AS correlation FROM pq"


def _pairs_rounded(p, keys):
    return p.select(*keys, F.round("distance", 6).alias("distance"), F.round("cosine_similarity", 6).alias("cosine_similarity"), F.round("correlation", 5).alias("correlation"))


@query("signal_pairwise", BASE + _pair_sql("fv", ["cohort", "k"], "signal_id", ALL))
def signal_pairwise(spark, sf):
    return _pairs_rounded(G.pairwise(cloud(spark, sf), ALL), (*CK, "signal_a", "signal_b"))


@query("coloading_gate", BASE + _POS + " SELECT a.cohort, a.k, a.signal_id AS signal_a, b.signal_id AS signal_b, round(a.pc1_loading * b.pc1_loading, 5) AS pc1_coloading, abs(a.pc1_loading * b.pc1_loading) > 0.1 AS needs_granger, sign(a.pc1_loading) = sign(b.pc1_loading) AS same_side FROM ps a JOIN ps b ON a.cohort = b.cohort AND a.k = b.k AND a.signal_id < b.signal_id")
def coloading_gate(spark, sf):
    """Which pairs pass on to the costly operators."""
    p = G.pairwise(loadings(spark, sf), ["pc1_loading"], loading="pc1_loading")
    return p.select(*CK, "signal_a", "signal_b", F.round("pc1_coloading", 5).alias("pc1_coloading"), "needs_granger", "same_side")


_GRAD = "CASE WHEN y0 IS NULL AND y2 IS NULL THEN NULL WHEN y0 IS NULL THEN (y2 - y) / hb WHEN y2 IS NULL THEN (y - y0) / ha ELSE (ha * ha * y2 - hb * hb * y0 + (hb * hb - ha * ha) * y) / (ha * hb * (ha + hb)) END"


def grad_sql(name, src, y, x, keys, out):
    return f", {name}0 AS (SELECT *, {y} AS y, lag({y}) OVER z AS y0, lead({y}) OVER z AS y2, {x} - lag({x}) OVER z AS ha, lead({x}) OVER z - {x} AS hb FROM {src} WINDOW z AS (PARTITION BY {keys} ORDER BY {x})), {name} AS (SELECT * EXCLUDE (y, y0, y2, ha, hb), {_GRAD} AS {out} FROM {name}0)"


_DYN = dim_sql(SHAPE) + ", sr AS (SELECT cohort, (31 + 16 * k)::DOUBLE AS signal_0_end, effective_dim, total_variance, k FROM ee)" + grad_sql("g1", "sr", "effective_dim", "signal_0_end", "cohort", "velocity") + grad_sql("g2", "g1", "velocity", "signal_0_end", "cohort", "acceleration") + grad_sql("g3", "g2", "acceleration", "signal_0_end", "cohort", "jerk")


def dims(spark, sf):
    d = G.effective_dim(cloud(spark, sf), SHAPE)
    return d.withColumn("signal_0_end", (31 + 16 * F.col("k")).cast("double"))


@query("geometry_dynamics", BASE + _DYN + " SELECT cohort, signal_0_end, round(effective_dim, 6) AS effective_dim, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(jerk, 6) AS jerk, round(abs(acceleration) / (1 + velocity ** 2) ** 1.5, 6) AS curvature, round(abs(velocity), 6) AS speed FROM g3")
def geometry_dynamics(spark, sf):
    d = G.dynamics(dims(spark, sf))
    return rounded(d.select("cohort", "signal_0_end", "effective_dim", "velocity", "acceleration", "jerk", "curvature", "speed"), ("cohort", "signal_0_end"))


@query("collapse_detect", BASE + _DYN + """, lo AS (SELECT *, coalesce(velocity < -0.002, false) AS low, row_number() OVER (PARTITION BY cohort ORDER BY signal_0_end) - 1 AS pos FROM g3),
ch AS (SELECT *, CASE WHEN low = lag(low) OVER (PARTITION BY cohort ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM lo), ru AS (SELECT *, sum(nw) OVER (PARTITION BY cohort ORDER BY pos) AS run FROM ch),
rl AS (SELECT cohort, run, count(*) AS len, min(pos) AS onset FROM ru WHERE low GROUP BY ALL HAVING count(*) >= 2), bs AS (SELECT cohort, onset FROM rl QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY len DESC, onset) = 1), nn AS (SELECT cohort, count(*) AS n FROM g3 GROUP BY cohort)
SELECT nn.cohort, coalesce(onset, -1)::INT AS collapse_onset_idx, round(coalesce(onset / n, -1), 6) AS collapse_onset_fraction FROM nn LEFT JOIN bs ON nn.cohort = bs.cohort""")
def collapse_detect(spark, sf):
    c = G.collapse(G.dynamics(dims(spark, sf)), threshold=-0.002, least=2)
    return c.select("cohort", "collapse_onset_idx", F.round("collapse_onset_fraction", 6).alias("collapse_onset_fraction"))


@query("thermodynamics", BASE + _DYN + _EIG + """, jn AS (SELECT g3.cohort, g3.effective_dim, g3.velocity, l1 * n_signals / (n_signals - 1) AS e1, l2 * n_signals / (n_signals - 1) AS e2, l3 * n_signals / (n_signals - 1) AS e3 FROM g3 JOIN sg ON g3.cohort = sg.cohort AND g3.k = sg.k),
th AS (SELECT cohort, avg(e1) AS e1, avg(e2) AS e2, avg(e3) AS e3, avg(effective_dim) AS energy, stddev_pop(effective_dim) AS energy_std, var_pop(velocity) AS temperature, count(*) AS n_samples FROM jn GROUP BY cohort),
ts AS (SELECT *, -(e1 / (e1 + e2 + e3)) * ln(e1 / (e1 + e2 + e3) + 1e-10) - (e2 / (e1 + e2 + e3)) * ln(e2 / (e1 + e2 + e3) + 1e-10) - (e3 / (e1 + e2 + e3)) * ln(e3 / (e1 + e2 + e3) + 1e-10) AS entropy FROM th)
SELECT cohort, n_samples, round(entropy, 6) AS entropy, round(energy, 6) AS energy, round(energy_std, 6) AS energy_std, round(temperature, 9) AS temperature, round(energy - entropy * temperature, 6) AS free_energy FROM ts""")
def thermodynamics(spark, sf):
    c = cloud(spark, sf)
    s = G.dynamics(dims(spark, sf)).join(G.eigen3(c, SHAPE).select(*CK, "eigenvalue_1", "eigenvalue_2", "eigenvalue_3"), list(CK))
    t = G.thermodynamics(s)
    return t.select("cohort", "n_samples", *(F.round(x, 9 if x == "temperature" else 6).alias(x) for x in ("entropy", "energy", "energy_std", "temperature", "free_energy")))


def _jack():
    fs = SHAPE
    pairs = list(itertools.combinations_with_replacement(fs, 2))
    s = ", jk AS (SELECT *, count(*) OVER p AS n, " + ", ".join(f"sum({f}) OVER p - {f} AS s_{f}" for f in fs) + ", " + ", ".join(f"sum({a} * {b}) OVER p - {a} * {b} AS p_{a}_{b}" for a, b in pairs) + " FROM fv WINDOW p AS (PARTITION BY cohort, k))"
    s += ", jv AS (SELECT cohort, k, n, " + ", ".join(f"(p_{a}_{b} - s_{a} * s_{b} / (n - 1)) / (n - 2) AS v_{a}_{b}" for a, b in pairs) + " FROM jk WHERE n >= 4)"
    quantiles = ", ".join(f"({n}, {K.student_quantile(0.975, n)!r}::DOUBLE)" for n in range(3, 31))
    tr, nm = " + ".join(f"v_{f}_{f}" for f in fs), " + ".join(("" if a == b else "2 * ") + f"v_{a}_{b} ** 2" for a, b in pairs)
    s += f", jd AS (SELECT cohort, k, ({tr}) ** 2 / nullif({nm}, 0) AS dim FROM jv), js AS (SELECT cohort, k, avg(dim) AS m, sqrt((count(*) - 1) * var_pop(dim)) AS s, count(*) - 1 AS df FROM jd GROUP BY cohort, k)"
    return s + f" SELECT cohort, k, round(m, 6) AS eff_dim_mean, round(s, 6) AS eff_dim_std, round(m - tq.t * s, 6) AS eff_dim_lower, round(m + tq.t * s, 6) AS eff_dim_upper FROM js LEFT JOIN (VALUES {quantiles}) AS tq(df, t) ON tq.df = js.df"


@query("jackknife_dim", BASE + _jack())
def jackknife_dim(spark, sf):
    return rounded(G.jackknife_dim(cloud(spark, sf), SHAPE), CK)


@query("axis_continuity", BASE + _EIG + """, ax AS (SELECT cohort, k, s * v1 / vn AS a, s * v2 / vn AS b, s * v3 / vn AS c FROM sg), ad AS (SELECT *, coalesce((a * lag(a) OVER z + b * lag(b) OVER z + c * lag(c) OVER z < 0)::INT, 0) AS n FROM ax WINDOW z AS (PARTITION BY cohort ORDER BY k)),
as_ AS (SELECT *, 1 - 2 * (sum(n) OVER (PARTITION BY cohort ORDER BY k) % 2) AS s FROM ad) SELECT cohort, k, round(s * a, 5) AS pc_1, round(s * b, 5) AS pc_2, round(s * c, 5) AS pc_3, s < 0 AS turned FROM as_""")
def axis_continuity(spark, sf):
    """The leading axis carried from window to window without reversals."""
    a = G.continuous_axes(G.eigen3(cloud(spark, sf), SHAPE))
    return a.select(*CK, *(F.round(c, 5).alias(c) for c in ("pc_1", "pc_2", "pc_3")), "turned")


@query("phase_space", BASE + dim_sql(SHAPE) + ", px AS (SELECT cohort, k, effective_dim AS x_0, lead(effective_dim, 2) OVER z AS x_1, lead(effective_dim, 4) OVER z AS x_2 FROM ee WINDOW z AS (PARTITION BY cohort ORDER BY k)) SELECT cohort, k, round(x_0, 6) AS x_0, round(x_1, 6) AS x_1, round(x_2, 6) AS x_2 FROM px WHERE x_2 IS NOT NULL")
def phase_space(spark, sf):
    return rounded(G.phase_space(G.effective_dim(cloud(spark, sf), SHAPE), "effective_dim", 3, 2), CK)


_SMO = dim_sql(SHAPE) + ", s0 AS (SELECT cohort, (31 + 16 * k)::DOUBLE AS signal_0_end, effective_dim AS e, k FROM ee), sr AS (SELECT cohort, signal_0_end, k, (coalesce(lag(e) OVER z, 0) + e + coalesce(lead(e) OVER z, 0)) / 3 AS effective_dim FROM s0 WINDOW z AS (PARTITION BY cohort ORDER BY signal_0_end))"
_SMO += "".join(grad_sql(n, src, y, "signal_0_end", "cohort", out) for n, src, y, out in (("g1", "sr", "effective_dim", "velocity"), ("g2", "g1", "velocity", "acceleration"), ("g3", "g2", "acceleration", "jerk")))


@query("geometry_dynamics_smoothed", BASE + _SMO + " SELECT cohort, signal_0_end, round(effective_dim, 6) AS effective_dim, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(jerk, 6) AS jerk FROM g3")
def geometry_dynamics_smoothed(spark, sf):
    d = G.dynamics(dims(spark, sf), smooth=True)
    return rounded(d.select("cohort", "signal_0_end", "effective_dim", "velocity", "acceleration", "jerk"), ("cohort", "signal_0_end"))


@query("effective_dim_trend", BASE + dim_sql(SHAPE) + " SELECT cohort, round(regr_slope(effective_dim, k), 6) AS trend_slope, round(regr_r2(effective_dim, k), 6) AS trend_r2, count(*) AS n_windows FROM ee GROUP BY cohort")
def effective_dim_trend(spark, sf):
    return dims(spark, sf).groupBy("cohort").agg(F.round(F.regr_slope("effective_dim", "k"), 6).alias("trend_slope"), F.round(F.regr_r2("effective_dim", "k"), 6).alias("trend_r2"), F.count("*").alias("n_windows"))


_VEL = """, z AS (SELECT cohort, signal_id, signal_0, (value - avg(value) OVER p) / stddev_pop(value) OVER p AS s FROM obs WINDOW p AS (PARTITION BY cohort, signal_id)),
v1 AS (SELECT *, lead(signal_0) OVER q - signal_0 AS h, lead(s) OVER q - s AS ds FROM z WINDOW q AS (PARTITION BY cohort, signal_id ORDER BY signal_0)), v2 AS (SELECT *, ds / h AS v FROM v1),
v3 AS (SELECT *, (v - lag(v) OVER q) / ((h + lag(h) OVER q) / 2) AS a FROM v2 WINDOW q AS (PARTITION BY cohort, signal_id ORDER BY signal_0)),
vs AS (SELECT cohort, signal_0, sum(v * v) AS v2, sum(a * v) AS av, sum(a * a) AS a2, arg_max(signal_id, (round(abs(v), 12), signal_id)) AS dm, max(v * v) AS tp, sum(CASE WHEN v <> 0 THEN v * v * ln(v * v) ELSE 0 END) AS vl FROM v3 WHERE v IS NOT NULL GROUP BY cohort, signal_0),
vf AS (SELECT *, av / nullif(sqrt(v2), 0) AS al FROM vs)"""


@query("velocity_field", S.obs("lineitem") + _VEL + " SELECT cohort, signal_0, round(sqrt(v2), 6) AS speed, round(sqrt(a2), 6) AS acceleration_magnitude, round(al, 6) AS acceleration_parallel, round(sqrt(greatest(a2 - al * al, 0)), 5) AS acceleration_perpendicular, dm AS dominant_motion_signal, round(tp / nullif(v2, 0), 6) AS dominant_motion_fraction, round(exp(ln(nullif(v2, 0)) - vl / nullif(v2, 0)), 6) AS motion_dimensionality FROM vf")
def velocity_field(spark, sf):
    v = D.velocity_field(O.obs_lineitem(spark, sf)).drop("curvature")
    return v.select("cohort", "signal_0", "dominant_motion_signal", *(F.round(c, 5 if c == "acceleration_perpendicular" else 6).alias(c) for c in v.columns if c not in ("cohort", "signal_0", "dominant_motion_signal")))


_RID = S.hops(32, 16) + ", fl AS (SELECT cohort, signal_id, (31 + 16 * k)::DOUBLE AS signal_0_end, regr_slope(value, i) AS ftle FROM c GROUP BY cohort, signal_id, k)" + grad_sql("g1", "fl", "ftle", "signal_0_end", "cohort, signal_id", "gr") + grad_sql("g2", "g1", "gr", "signal_0_end", "cohort, signal_id", "ac") + ", sp AS (SELECT cohort, signal_0_end, avg(abs(ftle)) AS speed FROM fl GROUP BY ALL), rj AS (SELECT g2.*, speed, speed * gr AS ug FROM g2 JOIN sp USING (cohort, signal_0_end))"


@query("ridge_proximity", _RID + " SELECT cohort, signal_id, signal_0_end, round(ftle, 6) AS ftle_current, round(gr, 6) AS ftle_gradient, round(ac, 6) AS ftle_acceleration, round(speed, 6) AS speed, round(ug, 6) AS urgency, round(CASE WHEN ftle < 0 AND gr > 0 THEN -ftle / gr END, 4) AS time_to_ridge, CASE WHEN ug > 0.02 THEN 'critical' WHEN ug > 0.01 THEN 'approaching' WHEN ug < -0.01 THEN 'receding' ELSE 'stable' END AS urgency_class FROM rj")
def ridge_proximity(spark, sf):
    """The operator on a stand-in field, the windows' slopes: it takes any rolling exponent."""
    rows = W.hop(W.indexed(O.obs_events(spark, sf)), 32, 16)
    f = E.trend(rows).select("cohort", "signal_id", (31 + 16 * F.col("k")).cast("double").alias("signal_0_end"), F.col("trend_slope").alias("ftle"))
    speed = f.groupBy("cohort", "signal_0_end").agg(F.avg(F.abs("ftle")).alias("speed"))
    r = D.ridge_proximity(f, speed)
    return r.select("cohort", "signal_id", "signal_0_end", "urgency_class", F.round("time_to_ridge", 4).alias("time_to_ridge"), *(F.round(c, 6).alias(c) for c in ("ftle_current", "ftle_gradient", "ftle_acceleration", "speed", "urgency")))


@query("stability_classes", S.hops(32, 16) + ", fl AS (SELECT cohort, signal_id, k, regr_slope(value, i) AS ftle FROM c GROUP BY cohort, signal_id, k) SELECT cohort, signal_id, k, CASE WHEN ftle < -0.1 THEN 'STRONGLY_STABLE' WHEN ftle < -0.01 THEN 'STABLE' WHEN ftle <= 0.01 THEN 'MARGINAL' WHEN ftle <= 0.1 THEN 'WEAKLY_UNSTABLE' ELSE 'CHAOTIC' END AS stability FROM fl")
def stability_classes(spark, sf):
    rows = W.hop(W.indexed(O.obs_events(spark, sf)), 32, 16)
    return E.trend(rows).select("cohort", "signal_id", "k", D.stability_class(F.col("trend_slope")).alias("stability"))


@query("csd", S.hops(50, 10) + """, l AS (SELECT *, lag(d) OVER (PARTITION BY cohort, signal_id, k ORDER BY i) AS d0 FROM c), p AS (SELECT cohort, signal_id, k, sum(d * d0) / nullif(sum(d * d), 0) AS ac, var_pop(value) AS va, avg(d ** 3) / nullif(avg(d * d) ** 1.5, 0) AS sk FROM l GROUP BY cohort, signal_id, k),
s AS (SELECT cohort, signal_id, count(*) AS n_windows, avg(ac) AS ma, arg_max(ac, k) AS la, regr_slope(ac, k) AS sa, regr_slope(va, k) AS sv, avg(abs(sk)) AS ms FROM p GROUP BY cohort, signal_id),
q AS (SELECT *, 0.3 * least(greatest(la, 0), 1) + 0.25 * (sa > 0)::INT + 0.25 * (sv > 0)::INT + 0.2 * least(greatest(ms, 0), 1) AS sc FROM s)
SELECT cohort, signal_id, n_windows, round(ma, 6) AS mean_ac1, round(la, 6) AS last_ac1, round(sa, 6) AS ac1_slope, round(sv, 4) AS variance_slope, round(ms, 6) AS mean_abs_skew, round(sc, 6) AS csd_score, sc > 0.6 AND la > 0.7 AND sa > 0 AS csd_detected FROM q""")
def csd(spark, sf):
    s = D.slowing_down(O.obs_events(spark, sf))
    return s.select("cohort", "signal_id", "n_windows", "csd_detected", F.round("variance_slope", 4).alias("variance_slope"), *(F.round(c, 6).alias(c) for c in ("mean_ac1", "last_ac1", "ac1_slope", "mean_abs_skew", "csd_score")))


PR = S.obs() + ", pr AS (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, a.signal_0 AS t, a.value AS x, b.value AS y FROM obs a JOIN obs b ON a.cohort = b.cohort AND a.signal_0 = b.signal_0 AND a.signal_id < b.signal_id)"
PK = "cohort, signal_a, signal_b"


def bins_sql(n, shared=False):
    lo = lambda c: "least(min(x) OVER p, min(y) OVER p)" if shared else f"min({c}) OVER p"
    hi = lambda c: "greatest(max(x) OVER p, max(y) OVER p)" if shared else f"max({c}) OVER p"
    return f", bn AS (SELECT *, {', '.join(f'coalesce(least(floor(({c} - {lo(c)}) / nullif(({hi(c)} - {lo(c)}) / {n}, 0)), {n - 1}), 0) AS q{c}' for c in 'xy')} FROM pr WINDOW p AS (PARTITION BY {PK}))"


def pairs(spark, sf):
    return P.aligned(O.obs_events(spark, sf))


PAIR = P.PAIR


@query("mutual_info", PR + bins_sql(10) + f""", h AS (SELECT {PK}, qx, qy, count(*) AS m FROM bn GROUP BY ALL), t AS (SELECT *, m / sum(m) OVER (PARTITION BY {PK}) AS p, sum(m) OVER (PARTITION BY {PK}, qx) / sum(m) OVER (PARTITION BY {PK}) AS px, sum(m) OVER (PARTITION BY {PK}, qy) / sum(m) OVER (PARTITION BY {PK}) AS py FROM h)
SELECT {PK}, round(sum(p * ln(p / (px * py))), 6) AS mutual_info, round(sum(p * ln(p / (px * py))) / sqrt(sum(-p * ln(px)) * sum(-p * ln(py))), 6) AS normalized_mi FROM t GROUP BY {PK}""")
def mutual_info(spark, sf):
    return rounded(P.mutual_information(pairs(spark, sf)), PAIR)


def _te(s, t, name):
    return f", c_{name} AS (SELECT {PK}, nx, nw, sr, count(*) AS m FROM (SELECT {PK}, lead(q{t}) OVER (PARTITION BY {PK} ORDER BY t) AS nx, q{t} AS nw, q{s} AS sr FROM bn) WHERE nx IS NOT NULL GROUP BY ALL), e_{name} AS (SELECT {PK}, sum(m * log2(m * no / (ns * nn))) / sum(m) AS {name}, sum(m * log2(m * no / (ns * nn))) / sum(-m * log2(nxs / tot)) AS {name}_norm FROM (SELECT *, sum(m) OVER (PARTITION BY {PK}, nx) AS nxs, sum(m) OVER (PARTITION BY {PK}) AS tot, sum(m) OVER (PARTITION BY {PK}, nw, sr) AS ns, sum(m) OVER (PARTITION BY {PK}, nx, nw) AS nn, sum(m) OVER (PARTITION BY {PK}, nw) AS no FROM c_{name}) GROUP BY {PK})"


@query("transfer_entropy", PR + bins_sql(8) + _te("x", "y", "te_a_to_b") + _te("y", "x", "te_b_to_a") + f" SELECT {PK}, round(te_a_to_b, 6) AS te_a_to_b, round(te_b_to_a, 6) AS te_b_to_a, round(te_a_to_b_norm, 6) AS te_a_to_b_norm, round(te_b_to_a_norm, 6) AS te_b_to_a_norm FROM e_te_a_to_b JOIN e_te_b_to_a USING ({PK})")
def transfer_entropy(spark, sf):
    return rounded(P.transfer_entropy(pairs(spark, sf)), PAIR)


@query("kl_js", PR + bins_sql(10, True) + f""", l AS (SELECT {PK}, qx AS c, 1 AS p, 0 AS q FROM bn UNION ALL SELECT {PK}, qy, 0, 1 FROM bn), h AS (SELECT {PK}, c, sum(p) AS p, sum(q) AS q FROM l GROUP BY ALL), f AS (SELECT {PK}, p / sum(p) OVER (PARTITION BY {PK}) + 1e-10 AS p, q / sum(q) OVER (PARTITION BY {PK}) + 1e-10 AS q FROM h)
SELECT {PK}, round(sum(p * ln(p / q)), 6) AS kl_ab, round(sum(q * ln(q / p)), 6) AS kl_ba, round(sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))), 6) AS js FROM f GROUP BY {PK}""")
def kl_js(spark, sf):
    return rounded(P.divergence(pairs(spark, sf)), PAIR)


@query("cross_corr", PR + f""", zz AS (SELECT *, row_number() OVER (p ORDER BY t) AS r, count(*) OVER p AS n, (x - avg(x) OVER p) / stddev_pop(x) OVER p AS zx, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS zy FROM pr WINDOW p AS (PARTITION BY {PK})),
xc AS (SELECT a.cohort, a.signal_a, a.signal_b, b.r - a.r AS lag, sum(a.zx * b.zy) / any_value(a.n) AS xc FROM zz a JOIN zz b ON a.cohort = b.cohort AND a.signal_a = b.signal_a AND a.signal_b = b.signal_b AND b.r BETWEEN a.r - 50 AND a.r + 50 GROUP BY ALL)
SELECT {PK}, round(arg_max(xc, (round(abs(xc), 12), -abs(lag), lag)), 6) AS max_xcorr, arg_max(lag, (round(abs(xc), 12), -abs(lag), lag))::INT AS lag_at_max, round(least(sum(abs(xc)) FILTER (lag > 0), sum(abs(xc)) FILTER (lag < 0)) / greatest(sum(abs(xc)) FILTER (lag > 0), sum(abs(xc)) FILTER (lag < 0)), 6) AS xcorr_symmetry FROM xc GROUP BY {PK}""")
def cross_corr(spark, sf):
    c = P.cross_correlation(pairs(spark, sf))
    return c.select(*PAIR, "lag_at_max", F.round("max_xcorr", 6).alias("max_xcorr"), F.round("xcorr_symmetry", 6).alias("xcorr_symmetry"))


_RK = f", rk AS (SELECT *, row_number() OVER (PARTITION BY {PK} ORDER BY x, t) / (count(*) OVER (PARTITION BY {PK}) + 1) AS u, row_number() OVER (PARTITION BY {PK} ORDER BY y, t) / (count(*) OVER (PARTITION BY {PK}) + 1) AS v FROM pr)"
_KT = f", kt AS (SELECT a.cohort, a.signal_a, a.signal_b, avg(sign((a.u - b.u) * (a.v - b.v))) AS kendall FROM rk a JOIN rk b ON a.cohort = b.cohort AND a.signal_a = b.signal_a AND a.signal_b = b.signal_b AND a.t < b.t GROUP BY ALL)"


@query("kendall_spearman", PR + _RK + _KT + f", sp AS (SELECT {PK}, covar_pop(u, v) / (stddev_pop(u) * stddev_pop(v)) AS spearman FROM rk GROUP BY {PK}) SELECT {PK}, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall FROM sp JOIN kt USING ({PK})")
def kendall_spearman(spark, sf):
    return rounded(P.rank_correlation(pairs(spark, sf)), PAIR)


@query("tail_dependence", PR + _RK + f" SELECT {PK}, round(avg((u < 0.1 AND v < 0.1)::INT) / 0.1, 6) AS lower_tail, round(avg((u > 0.9 AND v > 0.9)::INT) / 0.1, 6) AS upper_tail FROM rk GROUP BY {PK}")
def tail_dependence(spark, sf):
    return rounded(P.tails(pairs(spark, sf)), PAIR)


@query("copula_families", PR + _RK + _KT + f", th AS (SELECT *, CASE WHEN kendall > 0 AND kendall < 1 THEN 2 * kendall / (1 - kendall) END AS cl, CASE WHEN kendall >= 0 AND kendall < 1 THEN 1 / (1 - kendall) END AS gu FROM kt) SELECT {PK}, round(sin(kendall * pi() / 2), 6) AS gaussian_rho, round(cl, 6) AS clayton_theta, round(gu, 6) AS gumbel_theta, round(2 ** (-1 / cl), 6) AS clayton_lower_tail, round(2 - 2 ** (1 / gu), 6) AS gumbel_upper_tail FROM th")
def copula_families(spark, sf):
    return rounded(P.copulas(P.rank_correlation(pairs(spark, sf))), PAIR)


@query("coint_ols", PR + f""", o AS (SELECT {PK}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pr GROUP BY {PK}), e AS (SELECT pr.*, a, b, y - b * x - a AS e FROM pr JOIN o USING ({PK})), f AS (SELECT *, lag(e) OVER (PARTITION BY {PK} ORDER BY t) AS e0 FROM e),
s AS (SELECT {PK}, any_value(b) AS b, any_value(a) AS a, regr_slope(e, e0) AS phi, stddev_samp(e) AS sd, arg_max(e, t) AS ls FROM f GROUP BY {PK}) SELECT {PK}, round(b, 6) AS hedge_ratio, round(a, 6) AS intercept, round(CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END, 6) AS half_life, round(ls / sd, 6) AS spread_zscore FROM s""")
def coint_ols(spark, sf):
    return rounded(P.cointegration(pairs(spark, sf)), PAIR)


__all__ = ["r6", "cloud", "dims", "loadings", "pairs"]
