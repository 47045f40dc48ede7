"""Fleet operators, learner features, relational verbs and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import dynamics as D
from ..operators import engines as E
from ..operators import features as X
from ..operators import fleet as FL
from ..operators import geometry as G
from ..operators import validation as V
from ..sources import observations as O
from . import sql as S
from .catalog import query, rounded
from .geometry_queries import ALL, BASE, SHAPE, _pair_sql, _pairs_rounded, cloud, cloud_sql, dim_sql, grad_sql
from .signal_queries import r6

STATE = [f"state_{f}" for f in SHAPE]
SUP = cloud_sql(32, 16, "supplier")
_CV = ", cv AS (SELECT cohort, k, " + ", ".join(f"avg({f}) AS state_{f}" for f in SHAPE) + " FROM fv GROUP BY cohort, k)"


def sup_cloud(spark, sf):
    """The shape of windows alone: no query of suppliers asks for their trend."""
    return E.statistics(W.hop(O.obs_supplier(spark, sf), 32, 16))


def states(spark, sf):
    return sup_cloud(spark, sf).groupBy("cohort", "k").agg(*(F.avg(f).alias(f"state_{f}") for f in SHAPE))


@query("system_vector", SUP + _CV + ", cc AS (SELECT *, " + ", ".join(f"avg({f}) OVER p AS c_{f}" for f in STATE) + " FROM cv WINDOW p AS (PARTITION BY k)), dd AS (SELECT *, sqrt(" + " + ".join(f"({f} - c_{f}) ** 2" for f in STATE) + ") AS dist FROM cc) SELECT k, count(*) AS n_cohorts, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance, round(stddev_pop(dist), 6) AS std_distance FROM dd GROUP BY k")
def system_vector(spark, sf):
    c = G.centroid(states(spark, sf), STATE, keys=("k",)).withColumnRenamed("n_signals", "n_cohorts")
    return rounded(c.select("k", "n_cohorts", "mean_distance", "max_distance", "std_distance"), ("k", "n_cohorts"))


@query("system_geometry", (SUP + _CV + dim_sql(STATE, "k").replace("FROM fv", "FROM cv")) + " SELECT k, n_signals AS n_cohorts, round(effective_dim, 6) AS effective_dim, round(total_variance, 6) AS total_variance FROM ee")
def system_geometry(spark, sf):
    d = G.effective_dim(states(spark, sf), STATE, keys=("k",)).withColumnRenamed("n_signals", "n_cohorts").drop("n_features")
    return rounded(d, ("k", "n_cohorts"))


@query("cohort_pairwise_fleet", SUP + _CV + _pair_sql("cv", ["k"], "cohort", STATE).replace("cohort_a", "cohort_a"))
def cohort_pairwise_fleet(spark, sf):
    return _pairs_rounded(G.pairwise(states(spark, sf), STATE, keys=("k",), member="cohort", blocks=4), ("k", "cohort_a", "cohort_b"))


@query("system_velocity", SUP + _CV + """, lg AS (SELECT cohort, signal_id, k::DOUBLE AS t, value FROM (UNPIVOT cv ON state_kurtosis, state_skewness, state_crest_factor INTO NAME signal_id VALUE value)),
z AS (SELECT *, (value - avg(value) OVER p) / CASE WHEN stddev_pop(value) OVER p < 1e-10 THEN 1 ELSE stddev_pop(value) OVER p END AS s FROM lg WINDOW p AS (PARTITION BY cohort, signal_id)), v AS (SELECT *, lead(s) OVER (PARTITION BY cohort, signal_id ORDER BY t) - s AS v FROM z)
SELECT cohort, t AS signal_0, round(sqrt(sum(v * v)), 6) AS speed, round(max(v * v) / sum(v * v), 6) AS dominant_motion_fraction FROM v WHERE v IS NOT NULL GROUP BY cohort, t""")
def system_velocity(spark, sf):
    s = states(spark, sf)
    long = s.unpivot(["cohort", "k"], STATE, "signal_id", "value").select("cohort", "signal_id", F.col("k").cast("double").alias("signal_0"), "value")
    return rounded(D.velocity_field(long).select("cohort", "signal_0", "speed", "dominant_motion_fraction"), ("cohort", "signal_0"))


_TWO = dim_sql(SHAPE) + ", e2 AS (SELECT cohort, k, 'shape' AS engine, effective_dim, total_variance FROM ee)" + dim_sql(ALL).replace("ed AS", "fd AS").replace("FROM ed", "FROM fd").replace("ee AS", "fe AS") + ", gm AS (SELECT * FROM e2 UNION ALL SELECT cohort, k, 'all', effective_dim, total_variance FROM fe)"


def geometry(spark, sf):
    c = cloud(spark, sf)
    one = lambda name, f: G.effective_dim(c, f).withColumn("engine", F.lit(name))
    g = one("shape", SHAPE).unionByName(one("all", ALL))
    return g.withColumn("signal_0_end", (31 + 16 * F.col("k")).cast("double"))


@query("cohort_pivot", BASE + _TWO + ", pv AS (SELECT cohort, (31 + 16 * k)::DOUBLE AS signal_0_end, max(effective_dim) FILTER (engine = 'shape') AS shape_effective_dim, max(total_variance) FILTER (engine = 'shape') AS shape_total_variance, max(effective_dim) FILTER (engine = 'all') AS all_effective_dim, max(total_variance) FILTER (engine = 'all') AS all_total_variance FROM gm GROUP BY ALL) SELECT cohort, signal_0_end, round(shape_effective_dim, 6) AS shape_effective_dim, round(shape_total_variance, 6) AS shape_total_variance, round(all_effective_dim, 6) AS all_effective_dim, round(all_total_variance, 6) AS all_total_variance, round(shape_effective_dim - lag(shape_effective_dim) OVER (PARTITION BY cohort ORDER BY signal_0_end), 6) AS shape_eff_dim_rate FROM pv")
def cohort_pivot(spark, sf):
    p = FL.pivot(geometry(spark, sf), ["shape", "all"], ["effective_dim", "total_variance"])
    return rounded(FL.rate(p, "shape_effective_dim", "shape_eff_dim_rate"), ("cohort", "signal_0_end"))


_SR = dim_sql(SHAPE) + ", sr AS (SELECT cohort, (31 + 16 * k)::DOUBLE AS signal_0_end, effective_dim, total_variance FROM ee)"


def dim_series(spark, sf):
    d = G.effective_dim(cloud(spark, sf), SHAPE)
    return d.select("cohort", (31 + 16 * F.col("k")).cast("double").alias("signal_0_end"), "effective_dim", "total_variance")


_ARC = ", st AS (SELECT *, coalesce(sqrt((effective_dim - lag(effective_dim) OVER w) ** 2 + (total_variance - lag(total_variance) OVER w) ** 2), 0) AS step FROM sr WINDOW w AS (PARTITION BY cohort ORDER BY signal_0_end)), ar AS (SELECT *, sum(step) OVER (PARTITION BY cohort ORDER BY signal_0_end) AS arc_length FROM st)"


@query("traj_signatures", BASE + _SR + _ARC + " SELECT cohort, signal_0_end, round(effective_dim, 6) AS effective_dim, round(total_variance, 6) AS total_variance, round(arc_length, 6) AS arc_length FROM ar")
def traj_signatures(spark, sf):
    return rounded(FL.signatures(dim_series(spark, sf)), ("cohort", "signal_0_end"))


@query("traj_match", BASE + _SR + _ARC + """, sc AS (SELECT CASE WHEN stddev_pop(effective_dim) < 1e-10 THEN 1 ELSE stddev_pop(effective_dim) END AS a, CASE WHEN stddev_pop(total_variance) < 1e-10 THEN 1 ELSE stddev_pop(total_variance) END AS b FROM sr),
ds AS (SELECT x.cohort, y.cohort AS other, sqrt(avg(((x.effective_dim - y.effective_dim) / a) ** 2 + ((x.total_variance - y.total_variance) / b) ** 2)) AS d FROM sr x JOIN sr y ON x.signal_0_end = y.signal_0_end AND x.cohort <> y.cohort, sc GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY d, other) AS r FROM ds), mt AS (SELECT cohort, max(other) FILTER (r = 1) AS trajectory_id, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM rk GROUP BY cohort),
ps AS (SELECT cohort, arg_max(arc_length, signal_0_end) / max(arc_length) AS pos, count(*) AS n_windows FROM ar GROUP BY cohort) SELECT cohort, trajectory_id, n_windows, round(d1, 6) AS match_distance, round(d2, 6) AS second_distance, round(1 - d1 / d2, 6) AS match_confidence, round(pos, 6) AS trajectory_position FROM mt JOIN ps USING (cohort)""")
def traj_match(spark, sf):
    s = dim_series(spark, sf)
    return rounded(FL.match(s, s), ("cohort", "trajectory_id", "n_windows"))


_MET = "metrics AS (SELECT cohort, k AS t, effective_dim, total_variance FROM ee), lg AS (SELECT cohort, metric, t, value FROM (UNPIVOT metrics ON effective_dim, total_variance INTO NAME metric VALUE value))"
_CURVE = ["mean", "std", "min", "max", "range", "first", "last", "delta", "slope", "r2", "early", "late", "el_delta", "vel_mean", "vel_std", "vel_min", "vel_max", "vel_last", "acc_mean", "acc_std", "acc_min", "acc_max", "acc_last", "mid", "spike_ratio", "vel_late", "curvature_mean"]


@query("curve_features", BASE + dim_sql(SHAPE) + ", " + _MET + """, a AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY cohort, metric) AS n, value - lag(value) OVER w AS vel FROM lg WINDOW w AS (PARTITION BY cohort, metric ORDER BY t)), b AS (SELECT *, vel - lag(vel) OVER (PARTITION BY cohort, metric ORDER BY t) AS acc FROM a),
q AS (SELECT cohort, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, arg_min(value, r) AS first, arg_max(value, r) AS last, arg_max(value, r) - arg_min(value, r) AS delta, regr_slope(value, r) AS slope, CASE WHEN stddev_pop(value) < 1e-12 THEN 0 ELSE regr_r2(value, r) END AS r2,
avg(value) FILTER (r < greatest(n // 3, 1)) AS early, avg(value) FILTER (r >= n - greatest(n // 3, 1)) AS late, avg(value) FILTER (r >= n - greatest(n // 3, 1)) - avg(value) FILTER (r < greatest(n // 3, 1)) AS el_delta, avg(vel) AS vel_mean, stddev_pop(vel) AS vel_std, min(vel) AS vel_min, max(vel) AS vel_max, arg_max(vel, r) AS vel_last, avg(acc) AS acc_mean, stddev_pop(acc) AS acc_std, min(acc) AS acc_min, max(acc) AS acc_max, arg_max(acc, r) AS acc_last, avg(value) FILTER (r >= greatest(n // 3, 1) AND r < 2 * greatest(n // 3, 1)) AS mid,
max(value) / avg(value) FILTER (r < greatest(n // 3, 1)) AS spike_ratio, avg(vel) FILTER (r >= n - greatest((n - 1) // 3, 1)) AS vel_late, avg(abs(acc) / (1 + vel * vel) ** 1.5) AS curvature_mean FROM b GROUP BY cohort, metric) SELECT cohort, metric, n, """ + r6(*_CURVE) + " FROM q")
def curve_features(spark, sf):
    d = G.effective_dim(cloud(spark, sf), SHAPE).select("cohort", F.col("k").alias("t"), "effective_dim", "total_variance")
    return rounded(X.curve(d.unpivot(["cohort", "t"], ["effective_dim", "total_variance"], "metric", "value")), ("cohort", "metric", "n"))


def dim_axis(spark, sf):
    return G.effective_dim(cloud(spark, sf), SHAPE).select("cohort", F.col("k").alias("t"), F.col("effective_dim").alias("value"))


_AX = ", ax0 AS (SELECT cohort, effective_dim AS value, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY cohort) AS n, lead(effective_dim) OVER w AS nx, lag(effective_dim) OVER w AS pv FROM ee WINDOW w AS (PARTITION BY cohort ORDER BY k))"


def _q(p):
    return f"round(max(CASE WHEN floor((n - 1) * {p}) = r THEN value + ((n - 1) * {p} - r) * (coalesce(nx, value) - value) END), 6)"


@query("axis_features", BASE + dim_sql(SHAPE) + _AX + f" SELECT cohort, {_q(0.25)} AS q25, {_q(0.5)} AS q50, {_q(0.75)} AS q75, round(sum((r + 1) * value) / sum(r + 1), 6) AS position_weighted, round(avg((value < pv)::INT), 6) AS falling_share, round(arg_max(value, r) - arg_min(value, r), 6) AS delta FROM ax0 GROUP BY cohort")
def axis_features(spark, sf):
    return rounded(X.axis(dim_axis(spark, sf)), ("cohort",))


@query("cross_axis", BASE + _TWO + ", dl AS (SELECT cohort, engine, arg_max(effective_dim, k) - arg_min(effective_dim, k) AS delta FROM gm GROUP BY ALL) SELECT cohort, sum((delta < -0.15)::INT)::BIGINT AS n_collapsing, round(avg(delta), 6) AS mean_delta, round(max(delta) - min(delta), 6) AS delta_spread, round(greatest(sum((delta > 0)::INT), sum((delta < 0)::INT)) / count(*), 6) AS trajectory_agreement FROM dl GROUP BY cohort")
def cross_axis(spark, sf):
    d = geometry(spark, sf).groupBy("cohort", "engine").agg((F.max_by("effective_dim", "k") - F.min_by("effective_dim", "k")).alias("delta"))
    return rounded(X.cross_axis(d), ("cohort", "n_collapsing"))


@query("subwindow_dispersion", BASE + _TWO + ", pw AS (SELECT cohort, k, stddev_pop(effective_dim) AS s, max(effective_dim) - min(effective_dim) AS g, avg((total_variance > 3.4)::INT) AS d FROM gm GROUP BY ALL) SELECT cohort, round(avg(s), 6) AS sub_std_mean, round(max(g), 6) AS sub_range_max, round(avg(d), 6) AS degenerate_share, round(arg_max(g, k), 6) AS sub_range_last FROM pw GROUP BY cohort")
def subwindow_dispersion(spark, sf):
    g = geometry(spark, sf).withColumn("condition_number", F.col("total_variance"))
    return rounded(X.subwindow_dispersion(g, ("cohort", "k"), degenerate=3.4), ("cohort",))


@query("sensor_rolling", S.indexed() + " SELECT cohort, signal_id, signal_0, round(avg(value) OVER w, 7) AS roll_mean, round(coalesce(stddev_samp(value) OVER w, 0), 6) AS roll_std, round(value - first_value(value) OVER w, 6) AS roll_delta, CASE WHEN count(*) OVER w < 2 THEN 0 ELSE round(regr_slope(value, r) OVER w, 6) END AS roll_slope FROM r WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def sensor_rolling(spark, sf):
    s = X.sensor_rolling(O.obs_events(spark, sf))
    return s.select("cohort", "signal_id", "signal_0", F.round("roll_mean", 7).alias("roll_mean"), *(F.round(c, 6).alias(c) for c in ("roll_std", "roll_delta", "roll_slope")))


@query("expanding_statistics", BASE + dim_sql(SHAPE) + ", a AS (SELECT cohort, k AS t, effective_dim AS value, row_number() OVER (PARTITION BY cohort ORDER BY k) - 1 AS r FROM ee), e AS (SELECT *, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std, min(value) OVER w AS mn, max(value) OVER w AS mx, value - first_value(value) OVER w AS delta, regr_slope(value, r) OVER w AS slope, value - lag(value) OVER (PARTITION BY cohort ORDER BY t) AS vel FROM a WINDOW w AS (PARTITION BY cohort ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT cohort, t, round(value, 6) AS current, round(mean, 6) AS mean, round(std, 6) AS std, round(mn, 6) AS min, round(mx, 6) AS max, round(delta, 6) AS delta, round(CASE WHEN std > 1e-10 THEN (value - mean) / std ELSE 0 END, 6) AS spike, round(slope, 6) AS slope, round(vel, 6) AS vel, round(vel - lag(vel) OVER (PARTITION BY cohort ORDER BY t), 6) AS acc FROM e")
def expanding_statistics(spark, sf):
    return rounded(X.expanding(dim_axis(spark, sf)), ("cohort", "t"))


@query("fleet_relative", SUP + ", pc AS (SELECT cohort, avg(crest_factor) AS dist, regr_slope(crest_factor, k) AS slope FROM fv GROUP BY cohort), b AS (SELECT median(dist) AS md, avg(slope) AS ms, stddev_samp(slope) AS ss FROM pc) SELECT cohort, round(dist, 6) AS dist, round(slope, 6) AS slope, round(dist / md, 6) AS distance_ratio, round((slope - ms) / ss, 6) AS slope_z FROM pc, b")
def fleet_relative(spark, sf):
    per = sup_cloud(spark, sf).groupBy("cohort").agg(F.avg("crest_factor").alias("dist"), F.regr_slope("crest_factor", "k").alias("slope"))
    return rounded(X.fleet_relative(per, per, "dist", "slope").drop("slope_ratio"), ("cohort",))


@query("melt", S.obs("lineitem") + " SELECT cohort, signal_id, signal_0, value FROM obs")
def melt(spark, sf):
    return O.obs_lineitem(spark, sf)


@query("pivot_wide", S.obs() + " SELECT cohort, signal_0, " + ", ".join(f"max(value) FILTER (signal_id = 'u{i}') AS u{i}" for i in range(8)) + " FROM obs GROUP BY cohort, signal_0")
def pivot_wide(spark, sf):
    """Wide sensor matrix: signals named beforehand, so the plan needs no pass to find them."""
    return O.obs_events(spark, sf).groupBy("cohort", "signal_0").pivot("signal_id", [f"u{i}" for i in range(8)]).agg(F.max("value"))


@query("union_diagonal", S.obs() + " SELECT cohort, signal_id, count(*) AS n, NULL::DOUBLE AS top FROM obs GROUP BY ALL UNION ALL SELECT cohort, signal_id, NULL, max(value) FROM obs GROUP BY cohort, signal_id")
def union_diagonal(spark, sf):
    o = O.obs_events(spark, sf)
    return O.union_diagonal(o.groupBy("cohort", "signal_id").agg(F.count("*").alias("n")), o.groupBy("cohort", "signal_id").agg(F.max("value").alias("top")))


@query("semi_active", S.obs() + " SELECT cohort, signal_id, signal_0, value FROM obs WHERE signal_id IN (SELECT signal_id FROM obs GROUP BY signal_id HAVING avg(value) > 50)")
def semi_active(spark, sf):
    o = O.obs_events(spark, sf)
    return V.active_only(o, o.groupBy("signal_id").agg(F.avg("value").alias("m")).filter("m > 50").select("signal_id")).select("cohort", "signal_id", "signal_0", "value")


@query("anti_constant", S.obs("lineitem") + ", t AS (SELECT signal_id, stddev_pop(value) AS sd FROM obs GROUP BY signal_id) SELECT cohort, signal_id, count(*) AS n FROM obs WHERE signal_id NOT IN (SELECT signal_id FROM t WHERE sd <= 0.05) GROUP BY ALL")
def anti_constant(spark, sf):
    o = O.obs_lineitem(spark, sf)
    t = o.groupBy("signal_id").agg(F.stddev_pop("value").alias("signal_std"))
    return o.join(V.constant_signals(t, 0.05), "signal_id", "left_anti").groupBy("cohort", "signal_id").agg(F.count("*").alias("n"))


@query("dead_column_stats", S.obs() + ", h AS (SELECT CASE WHEN signal_0 % 10 > 0 THEN NULL ELSE value END AS mostly, CASE WHEN signal_0 % 10 = 0 THEN NULL ELSE value END AS rarely FROM obs) SELECT 'mostly' AS \"column\", round(avg((mostly IS NULL)::INT), 6) AS dead FROM h UNION ALL SELECT 'rarely', round(avg((rarely IS NULL)::INT), 6) FROM h")
def dead_column_stats(spark, sf):
    tenth = F.col("signal_0") % 10 == 0
    h = O.obs_events(spark, sf).select(F.when(tenth, F.col("value")).alias("mostly"), F.when(~tenth, F.col("value")).alias("rarely"))
    return V.dead_shares(h, ()).withColumn("dead", F.round("dead", 6))


@query("tail_cap", S.obs("lineitem") + " SELECT cohort, signal_id, signal_0, value FROM obs QUALIFY row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0 DESC) <= 2000")
def tail_cap(spark, sf):
    """The feature is the cap: the last 2000 samples of each series."""
    return V.tail(O.obs_lineitem(spark, sf))


@query("topk_drivers", S.obs() + ", s AS (SELECT cohort, signal_id, stddev_samp(value) AS sd FROM obs GROUP BY ALL) SELECT cohort, signal_id, round(sd, 6) AS sd FROM s ORDER BY s.sd DESC, cohort, signal_id LIMIT 5")
def topk_drivers(spark, sf):
    s = O.obs_events(spark, sf).groupBy("cohort", "signal_id").agg(F.stddev_samp("value").alias("s"))
    return s.orderBy(F.desc("s"), "cohort", "signal_id").limit(5).select("cohort", "signal_id", F.round("s", 6).alias("sd"))


@query("validate_observations", S.obs() + """ SELECT * FROM (SELECT 'rows' AS "check", count(*)::DOUBLE AS measured, 1.0::DOUBLE AS "limit", count(*) >= 1 AS passed FROM obs UNION ALL SELECT 'signals', count(DISTINCT signal_id), 1, count(DISTINCT signal_id) >= 1 FROM obs UNION ALL SELECT 'null', avg((value IS NULL OR isnan(value))::INT), 0.5, avg((value IS NULL OR isnan(value))::INT) <= 0.5 FROM obs
UNION ALL SELECT 'infinite', avg((isinf(value))::INT), 0, avg((isinf(value))::INT) <= 0 FROM obs UNION ALL SELECT 'no_coordinate', avg((signal_0 IS NULL)::INT), 0, avg((signal_0 IS NULL)::INT) <= 0 FROM obs)""")
def validate_observations(spark, sf):
    return V.validate(O.obs_events(spark, sf))


@query("inf_scrub", S.obs() + " SELECT cohort, signal_id, signal_0, CASE WHEN signal_0 % 5 <> 0 THEN value END AS value FROM obs")
def inf_scrub(spark, sf):
    o = O.obs_events(spark, sf)
    return V.scrub_infinite(o.withColumn("value", F.when(F.col("signal_0") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))))


@query("segments", S.obs() + " SELECT cohort, signal_id, CASE WHEN signal_0 < 100 THEN 'pre' ELSE 'post' END AS segment, count(*) AS n, round(avg(value), 6) AS mean FROM obs GROUP BY ALL")
def segments(spark, sf):
    return D.segments(O.obs_events(spark, sf), 100.0).groupBy("cohort", "signal_id", "segment").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("uneven_gradient", S.obs("events_ts") + grad_sql("g1", "obs", "value", "signal_0", "cohort, signal_id", "v") + " SELECT cohort, signal_id, count(*) AS n, round(avg(abs(v)), 6) AS mean_abs_velocity FROM g1 GROUP BY ALL")
def uneven_gradient(spark, sf):
    """Derivatives on an axis of uneven steps."""
    g = O.obs_events_ts(spark, sf).withColumn("v", W.gradient("value", "signal_0", ("cohort", "signal_id")))
    return g.groupBy("cohort", "signal_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("v")), 6).alias("mean_abs_velocity"))


@query("point_centroids", "WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings), c AS (SELECT *, avg(x) OVER (PARTITION BY label, pos) AS m FROM p), d AS (SELECT label, vec_id, sqrt(sum((x - m) ** 2)) AS dist FROM c GROUP BY ALL) SELECT label, count(*) AS n, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance, round(stddev_pop(dist), 6) AS std_distance FROM d GROUP BY label")
def point_centroids(spark, sf):
    p = O.points(spark, sf).withColumn("m", F.avg("x").over(Window.partitionBy("label", "pos")))
    d = p.groupBy("label", "vec_id").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("dist"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean_distance"), F.round(F.max("dist"), 6).alias("max_distance"), F.round(F.stddev_pop("dist"), 6).alias("std_distance"))
