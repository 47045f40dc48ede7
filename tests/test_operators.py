"""Operators on small frames, against hand-made answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import kernels as K
from orrery.functions import windows as W
from orrery.operators import breaks as B
from orrery.operators import engines as E
from orrery.operators import features as X
from orrery.operators import geometry as G
from orrery.operators import kernel_ops as KO
from orrery.operators import normalize as N
from orrery.operators import registry as R
from orrery.operators import validation as V
from orrery.sources import observations as O


def obs(spark, values, cohort="c", signal="s", coords=None):
    coords = range(len(values)) if coords is None else coords
    rows = [(cohort, signal, float(t), None if v is None else float(v)) for t, v in zip(coords, values, strict=True)]
    return spark.createDataFrame(rows, O.OBSERVATIONS)


def test_hops_match_slices(spark):
    y = np.random.RandomState(1).standard_normal(103)
    for look in (10, 20, 30):
        rows = W.hop(W.indexed(obs(spark, y)), 20, 7, look).groupBy("k").agg(F.avg("value").alias("m"), F.count("*").alias("n")).collect()
        got = {r.k: (r.m, r.n) for r in rows}
        want = {k: y[max(0, e - look + 1) : e + 1] for k, e in enumerate(range(19, 103, 7))}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k][1] == len(w) and got[k][0] == pytest.approx(w.mean())


def test_short_series_give_none_or_one_window(spark):
    rows = W.indexed(obs(spark, [1, 2, 3]))
    assert W.hop(rows, 5, 1).count() == 0
    assert W.hop(rows, 5, 1, short="one").count() == 3


def test_nulls_and_nans_are_no_samples(spark):
    assert W.indexed(obs(spark, [1, None, float("nan"), 2])).count() == 2


def test_gradient_on_uneven_axis(spark):
    c = [0, 1, 4, 10, 20]
    o = obs(spark, [3 * x + 1 for x in c], coords=c).withColumn("g", W.gradient("value", "signal_0", ("cohort", "signal_id")))
    assert [r.g for r in o.orderBy("signal_0").collect()] == pytest.approx([3.0] * 5)


def test_repeated_coordinates_stay_finite(spark):
    o = obs(spark, [1, 2, 3, 4], coords=[1, 1, 2, 3]).withColumn("g", W.gradient("value", "signal_0", ("cohort", "signal_id")))
    assert all(math.isfinite(r.g) for r in o.collect())


def test_fill_is_linear_and_flat_at_the_ends(spark):
    f = W.fill_linear(obs(spark, [None, 1, None, 3, None]), "value", ("cohort", "signal_id"), "signal_0")
    assert [r.value for r in f.orderBy("signal_0").collect()] == [1, 1, 2, 3, 3]


def test_engines_against_numpy(spark):
    y = np.random.RandomState(3).standard_normal(32)
    rows = W.hop(E.lagged(obs(spark, y), 1), 32, 16)
    s, t = E.statistics(rows).first(), E.trend(rows).first()
    d = y - y.mean()
    assert s.kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert s.crest_factor == pytest.approx(np.abs(y).max() / np.sqrt((y * y).mean()))
    assert t.trend_slope == pytest.approx(np.polyfit(range(32), y, 1)[0])
    c = np.cumsum(d)
    assert t.cusum_range == pytest.approx(c.max() - c.min())


def test_constant_signal(spark):
    rows = W.hop(E.lagged(obs(spark, [5] * 32), 1, 2, 4, 8), 32, 16)
    assert E.statistics(rows).first().kurtosis is None
    assert E.trend(rows).first().trend_r2 == 0.0
    v = E.variance_ratio(rows).first()
    assert (v.variance_ratio, v.variance_ratio_stat) == (1.0, 0.0)


@pytest.mark.parametrize("at,levels", [(500, (10, 20)), (500, (30, 10))])
def test_step_is_found(spark, at, levels):
    y = np.where(np.arange(1000) < at, *levels) + 0.01 * np.random.RandomState(0).standard_normal(1000)
    b = B.detect(obs(spark, y)).collect()
    near = [r for r in b if abs(r.signal_0 - at) <= 20]
    assert near and near[0].direction == (1 if levels[1] > levels[0] else -1) and near[0].duration <= 5


def test_spike_is_found(spark):
    y = 0.5 * np.random.RandomState(42).standard_normal(1000)
    y[500] = 50
    b = [r for r in B.detect(obs(spark, y), 1.5).collect() if abs(r.signal_0 - 500) <= 5]
    assert b and b[0].snr > 10


def test_quiet_short_and_constant_series_have_no_breaks(spark):
    y = np.random.RandomState(42).standard_normal(1000)
    assert B.detect(obs(spark, y), 0.3).count() == 0
    for v in ([1, 2, 3], [5] * 300):
        assert B.detect(obs(spark, v)).count() == 0


def test_break_summary(spark):
    rows = [("c", "s", 100.0, 3.0, 1.0, 4.0), ("c", "s", 200.0, 5.0, 2.0, 5.0), ("c", "s", 350.0, 4.0, 1.5, 6.0)]
    s = B.summary(spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, magnitude double, sharpness double, snr double")).first()
    assert (s.mean_spacing, s.max_magnitude, s.mean_sharpness) == (125.0, 5.0, 1.5)


def test_merging_keeps_the_better_of_near_candidates(spark):
    c = spark.createDataFrame([("c", "s", r, float(x)) for r, x in ((10, 3), (12, 5), (15, 4), (40, 1))], "cohort string, signal_id string, r long, score double")
    assert [(r.r, r.score) for r in B.merged(c, 10).orderBy("r").collect()] == [(12, 5.0), (40, 1.0)]


def cloud(spark, x, names=("a", "b", "c")):
    return spark.createDataFrame([("q", 0, f"s{i}", *map(float, r)) for i, r in enumerate(x)], "cohort string, k int, signal_id string, " + ", ".join(f"{n} double" for n in names))


def test_plan_and_kernel_agree_on_the_spectrum(spark):
    x = np.random.RandomState(9).standard_normal((12, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    c = cloud(spark, x)
    d = G.effective_dim(c, ["a", "b", "c"]).first()
    e = G.eigen3(c, ["a", "b", "c"]).first()
    k = KO.cohort_geometry(c, ["a", "b", "c"]).first()
    assert d.effective_dim == pytest.approx(k.effective_dim)
    assert d.total_variance == pytest.approx(k.total_variance)
    assert [e.eigenvalue_1, e.eigenvalue_2, e.eigenvalue_3] == pytest.approx([k.eigenvalue_1, k.eigenvalue_2, k.eigenvalue_3])
    assert k.eigenvalue_4 == 0.0


def test_jackknife_by_hand(spark):
    x = np.random.RandomState(2).standard_normal((8, 3))

    def dim(z):
        c = np.cov(z, rowvar=False)
        return np.trace(c) ** 2 / (c * c).sum()

    j = [dim(np.delete(x, i, 0)) for i in range(8)]
    r = G.jackknife_dim(cloud(spark, x), ["a", "b", "c"]).first()
    assert r.eff_dim_mean == pytest.approx(np.mean(j)) and r.eff_dim_std == pytest.approx(np.sqrt(7 * np.var(j)))


def test_collapse(spark):
    v = [3, 3, 2.95, 2.5, 2.0, 1.5, 1.5, 1.5]
    s = spark.createDataFrame([("q", float(i), float(x)) for i, x in enumerate(v)], "cohort string, signal_0_end double, effective_dim double")
    r = G.collapse(G.dynamics(s)).first()
    assert r.collapse_onset_idx == 2 and r.collapse_onset_fraction == pytest.approx(2 / 8)
    flat = G.collapse(G.dynamics(s.withColumn("effective_dim", F.lit(2.0)))).first()
    assert (flat.collapse_onset_idx, flat.collapse_onset_fraction) == (-1, -1.0)


def test_normalisations_invert(spark):
    o = obs(spark, np.random.RandomState(5).standard_normal(60) * 9 + 4)
    for m in N.Method:
        back = N.denormalise(N.normalise(o, m)).orderBy("signal_0").collect()
        assert [r.value for r in back] == pytest.approx([r.value for r in o.orderBy("signal_0").collect()])


def test_curve_features_of_a_line(spark):
    s = spark.createDataFrame([("q", "m", i, 10 * i / 19) for i in range(20)], "cohort string, metric string, t int, value double")
    r = X.curve(s).first()
    assert r.slope == pytest.approx(10 / 19) and r.r2 > 0.99 and r.vel_std < 1e-9
    sq = X.curve(s.withColumn("value", (F.col("t") * F.col("t")).cast("double"))).first()
    assert sq.acc_mean == pytest.approx(2.0)


def test_manifest_needs_its_parts():
    with pytest.raises(R.ManifestError, match="system.window"):
        R.Manifest.parse({"cohorts": {"a": {}}})
    m = R.Manifest.parse({"system": {"window": 8, "stride": 4}, "cohorts": {"a": {"s": {"engines": ["trend", "nope"], "engine_window_overrides": {"trend": 9}}}}, "engine_windows": {"trend": 7, "dfa": 30}})
    assert m.audit() == {"available": ["trend"], "missing": ["nope"]}
    assert (m.look_back("a", "s", "trend"), m.look_back("a", "t", "trend"), m.look_back("a", "s", "dfa")) == (9, 7, 30)


def test_signal_vector(spark):
    y = np.random.RandomState(8).standard_normal(100)
    m = R.Manifest.parse({"system": {"window": 32, "stride": 32}, "cohorts": {"c": {"s": {"engines": ["statistics", "garch"]}}}, "engine_windows": {"statistics": 32}})
    rows = R.signal_vector(obs(spark, y), m).orderBy("signal_0_end").collect()
    assert [r.signal_0_end for r in rows] == [31.0, 63.0, 95.0]
    d = y[:32] - y[:32].mean()
    assert rows[0].kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert rows[0].garch_omega is None and rows[0].engine_mask & 1


def test_validation(spark):
    o = obs(spark, [1, None, float("inf"), 2])
    got = {r.check: r.passed for r in V.validate(o, most_null=0.1).collect()}
    assert got == {"rows": True, "signals": True, "null": False, "infinite": False, "no_coordinate": True}
    with pytest.raises(V.InvalidObservations):
        V.validate(o.drop("value"))


def test_dead_columns_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i else 1.0, float(i)) for i in range(20)], "id int, dead double, live double")
    assert V.prune_dead_columns(df, ("id",)).columns == ["id", "live"]
    O.write_output(df.limit(0), str(tmp_path), "empty", {"live": {"unit": "m"}})
    back = O.read_output(spark, str(tmp_path), "empty")
    assert back.columns == ["id", "dead", "live"] and back.count() == 0
    assert back.schema["live"].metadata == {"unit": "m"}
    assert O.read_output(spark, str(tmp_path), "nothing") is None


def test_sensor_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 1 0.1 0.2 0.3 5 6\n1 2 0.1 0.2 0.3 7\n\n")
    wide = O.read_sensor_text(spark, str(tmp_path / "t.txt"), 3, 2)
    rows = sorted((r.signal_id, r.signal_0, r.value) for r in O.melt_sensors(wide).collect())
    assert rows == [("s1", 0.0, 5.0), ("s1", 1.0, 7.0), ("s2", 0.0, 6.0), ("s2", 1.0, None)]


def test_ready_stages():
    needs = {"a": (), "b": ("a",), "c": ("b", "a")}
    assert V.ready(set(), needs) == ["a"] and V.ready({"a"}, needs) == ["b"] and V.missing("c", set(), needs) == ["a", "b"]
    assert V.status({"a"}, needs) == {"a": "done", "b": "ready", "c": "waiting"}


def test_copulas_of_long_pairs_use_every_sample(spark):
    """At 1001 samples; the odd ones alone say the opposite of the even ones."""
    r = np.random.RandomState(3)
    x, e = r.standard_normal(1001), r.standard_normal(1001)
    y = np.where(np.arange(1001) % 2 == 0, x, -x) + 0.1 * e
    rows = [("c", "a", "b", float(i), float(x[i]), float(y[i])) for i in range(1001)]
    got = KO.copula_fits(spark.createDataFrame(rows, "cohort string, signal_a string, signal_b string, t double, x double, y double")).collect()
    want = np.sign((x[:, None] - x) * (y[:, None] - y)).sum() / (1001 * 1000)
    assert len(got) == 1 and got[0].kendall == pytest.approx(want, abs=1e-12) and abs(want) < 0.1
    assert got[0].aic == pytest.approx(K.copula_fit(x, y)["aic"])
