"""Engines by name against their plans, gates, chunks, stage needs, units, settings, and the numeric forms without SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import config
from orrery.functions import kernels as K
from orrery.functions import window_kernels as M
from orrery.functions import windows as W
from orrery.operators import engines as E
from orrery.operators import features as X
from orrery.operators import geometry as G
from orrery.operators import kernel_ops as KO
from orrery.operators import registry as R
from orrery.operators import typology as T
from orrery.plans import catalog, pipeline
from orrery.sources import observations as O
from orrery.sources import units as U


@pytest.fixture(scope="module")
def obs(spark):
    r = np.random.default_rng(2)
    rows = [("c", "walk", float(i), float(v)) for i, v in enumerate(np.cumsum(r.standard_normal(260)))]
    rows += [("c", "levels", float(i), float(v)) for i, v in enumerate(r.integers(0, 4, 260))]
    rows += [("c", "fall", float(i), math.exp(-i / 40) + 0.001 * float(v)) for i, v in enumerate(r.standard_normal(260))]
    return spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, value double").cache()


PLANS = {
    "statistics": (M.basic, lambda rows, arrays, lev: E.statistics(rows)), "peak": (M.peak, lambda rows, arrays, lev: E.peak_rms(rows)), "rms": (M.rms, lambda rows, arrays, lev: E.peak_rms(rows)),
    "trend": (M.trend, lambda rows, arrays, lev: E.trend(rows)), "change": (M.change, lambda rows, arrays, lev: E.rate_of_change(rows)), "relative": (M.relative_change, lambda rows, arrays, lev: E.rate_of_change(rows)),
    "variance_ratio": (M.variance_ratio, lambda rows, arrays, lev: E.variance_ratio(rows)), "acf": (M.acf_decay, lambda rows, arrays, lev: E.acf_decay(arrays)), "pulsation": (M.pulsation, lambda rows, arrays, lev: E.pulsation(rows)),
    "time_constant": (M.time_constant, lambda rows, arrays, lev: E.time_constant(rows)), "basin": (M.basin, lambda rows, arrays, lev: E.basin(rows)), "cycles": (M.cycle_counting, lambda rows, arrays, lev: E.cycle_counting(arrays)),
    "levels": (M.level_measures, lambda rows, arrays, lev: E.level_engines(lev)), "transitions": (M.transitions, lambda rows, arrays, lev: E.transition_matrix(lev)), "entropy": (M.raw_entropy, lambda rows, arrays, lev: E.raw_entropy(rows)),
    "dwell": (M.dwell_times, lambda rows, arrays, lev: E.dwell_times(rows)), "between": (M.mean_time_between, lambda rows, arrays, lev: E.mean_time_between(lev)),
    "mann_kendall": (M.mann_kendall, lambda rows, arrays, lev: E.mann_kendall(arrays)),
    "growth": (M.variance_growth, lambda rows, arrays, lev: E.variance_growth(arrays).withColumnRenamed("variance_ratio", "variance_growth_ratio")),
}


@pytest.mark.parametrize("name", list(PLANS))
def test_engines_by_name_equal_their_plans(obs, name):
    f, plan = PLANS[name]
    rows = W.hop(E.lagged(obs, 1, 2, 4, 8), 120, 70)
    want = {(r.signal_id, r.k): r for r in plan(rows, W.window_arrays(rows), E.levels(rows)).collect()}
    y = {s: [r.value for r in obs.filter(F.col("signal_id") == s).orderBy("signal_0").collect()] for s in ("walk", "levels", "fall")}
    assert len(want) == 9
    for (s, k), row in want.items():
        got, there = f(np.array(y[s][70 * k : 70 * k + 120])), row.asDict()
        for c in set(got) & set(there):
            a, b = got[c], there[c]
            assert (b is None and not math.isfinite(a)) or a == pytest.approx(b, rel=1e-6, abs=1e-9), (s, k, c)
        assert len(set(got) & set(there)) >= min(len(got), 2) - 1 + (len(got) == 1)


def test_every_name_is_registered_once():
    wanted = "statistics memory complexity spectral trend kurtosis skewness crest_factor hurst dfa acf_decay sample_entropy permutation_entropy perm_entropy approximate_entropy mann_kendall rate_of_change trend_r2 detrend_std cusum spectral_entropy band_power frequency_bands attractor lyapunov garch dmd envelope harmonics basin cycle_counting lof pulsation_index time_constant rate_of_change_detailed variance_growth fundamental_freq phase_coherence snr thd adf_stat variance_ratio dwell_times level_count level_histogram transition_matrix entropy transition_count duty_cycle mean_time_between rqa peak rms correlation_dimension determinism embedding_dim recurrence_rate hmm hilbert_stability wavelet_stability harmonic_ratio".split()
    assert set(wanted) == set(R.REGISTRY)
    with pytest.raises(ValueError, match="different things"):
        R.register("other", lambda y: {"kurtosis": 0.5})
    assert "other" not in R.REGISTRY
    c = R.columns_of(["statistics", "kurtosis", "complexity", "perm_entropy"])
    assert c["kurtosis"] == {"kurtosis": "kurtosis_kurtosis"} and c["statistics"]["kurtosis"] == "kurtosis" and c["perm_entropy"] == {"permutation_entropy": "perm_entropy_permutation_entropy"}


def test_gates_factors_and_relaxed_engines(spark, obs):
    m = R.Manifest.parse({"system": {"window": 64, "stride": 64}, "cohorts": {"*": {"*": {"engines": ["statistics", "lyapunov", "attractor", "level_count"]}}}})
    metrics = spark.createDataFrame([("c", s, k, None if s == "fall" else float(k), 64) for s in ("walk", "levels", "fall") for k in range(4)], "cohort string, signal_id string, k int, cv double, n_obs int")
    gates = {"statistics": {"cv": {"gt_skip": 1.5}}, "level_count": {"cv": {"min_obs": 100}}}
    at = {n: i for i, n in enumerate(R.REGISTRY)}
    has = lambda r, n: bool(r.engine_mask >> at[n] & 1)
    plain = R.signal_vector(obs, m).orderBy("signal_id", "signal_0_end").collect()
    # the first window holds 64 samples: enough for a relaxed engine's least, not for the full look-back of 128
    assert len(plain) == 12 and all(has(r, "statistics") and has(r, "lyapunov") and has(r, "attractor") == (r.signal_0_end > 100) for r in plain)
    rows = R.signal_vector(obs, m, gates=gates, metrics=metrics).orderBy("signal_id", "signal_0_end").collect()
    for r in rows:
        k = int(r.signal_0_end // 64)
        assert has(r, "statistics") == (r.signal_id == "fall" or k < 2) and not has(r, "level_count") and (r.kurtosis is None) == (not has(r, "statistics"))
    wide = R.signal_vector(obs, m, factors={"walk": 3.0}).filter("signal_id = 'walk'").orderBy("signal_0_end").collect()
    assert not has(wide[0], "attractor") and wide[0].kurtosis == pytest.approx(M.basic(np.array([r.value for r in obs.filter("signal_id = 'walk' and signal_0 between 16 and 63").orderBy("signal_0").collect()]))["kurtosis"])
    w = metrics.withColumn("x", F.lit(1.0))
    assert {r.engine_mask for r in T.gated(w, {"a": {"x": {"min_obs": 65}}, "b": {"x": {"min_obs": 64}}}).collect()} == {2}


def test_chunks_give_the_same_windows(obs):
    f = lambda y: {"m": float(y.mean()), "n": float(len(y))}
    whole = sorted(map(tuple, KO.per_window(obs, f, ["m", "n"], 30, 7).collect()))
    assert sorted(map(tuple, KO.per_window(obs, f, ["m", "n"], 30, 7, chunk=3).collect())) == whole and len(whole) == 3 * 33
    short = KO.per_window(obs.filter("signal_0 < 20"), f, ["m", "n"], 30, 7, chunk=2).collect()
    assert {(r.signal_id, r.k, r.n) for r in short} == {(s, 0.0, 20.0) for s in ("walk", "levels", "fall")}
    gaps = KO.per_window(obs.withColumn("value", F.when(F.col("signal_0") != 5, F.col("value"))), f, ["m", "n"], 30, 7).collect()
    assert all(r.n == 30 for r in gaps)


def test_stage_needs_are_what_stages_read(obs):
    job = pipeline.Job(obs.unionByName(obs.withColumn("cohort", F.lit("d"))), 32, 16)
    for name in pipeline.STAGES:
        job[name]
    assert {s: set(n) for s, n in pipeline.NEEDS.items()} == {s: job.needs.get(s, set()) for s in pipeline.STAGES}


def test_units_paths_and_description(spark, tmp_path, obs):
    assert U.output_path("r", "state_vector", nested=True) == "r/cohorts/cohort_vector" and U.output_path("r", "unknown", True) == "r/unknown"
    assert U.units_of("velocity_field", "h")["acceleration_magnitude"] == {"unit": "σ/h²"} and U.units_of("velocity_field")["speed"] == {"unit": "σ/step"}
    root = f"file://{tmp_path}"
    O.write_output(spark.range(3).withColumnRenamed("id", "speed"), root, "velocity_field", U.units_of("velocity_field", "s"))
    U.write_description(spark, root, ["velocity_field"])
    assert [tuple(r) for r in spark.read.parquet(f"{root}/_description").collect()] == [("velocity_field", "speed", "bigint", "σ/s")]
    assert spark.read.text(f"{root}/_readme").first()[0] == "velocity_field | speed | bigint | σ/s"


def test_sections_and_templates():
    s = config.Settings({"collapse": {"least": 5}})
    assert s.section("collapse") == {"threshold": -0.05, "least": 5} and s.section("phase_space")["dim"] == 3 and s.section("none") == {}
    assert "flagship_effective_dim" in catalog.templates() and catalog.template("hop_windows").startswith("WITH")
    with pytest.raises(KeyError):
        catalog.template("nothing")


def test_student_quantiles():
    assert K.student_quantile(0.975, 7) == pytest.approx(2.364624, abs=1e-5) and K.student_quantile(0.975, 10**7) == pytest.approx(1.959964, abs=1e-5)


def test_student_beyond_the_table(spark):
    got = spark.range(1).select(*(G.student(F.lit(n)).alias(f"t{n}") for n in (1, 30, 60, 61, 400))).first()
    for n in (1, 30, 60, 61, 400):
        assert got[f"t{n}"] == pytest.approx(K.student_quantile(0.975, n), abs=1e-5)


def test_feature_groups_fall_back():
    assert G.feature_groups(["kurtosis", "skewness", "hurst"]) == {"shape": ["kurtosis", "skewness"]}
    assert G.feature_groups(["kurtosis", "hurst", "x"], {"g": ["p", "q"]}) == {"full": ["kurtosis", "hurst", "x"]} and G.feature_groups(["x"]) == {}


def test_saddles_of_a_known_flow():
    """Near a saddle the local map has one rising and one falling direction; near a sink it has none rising."""
    g = np.linspace(-1, 1, 9)
    t = np.linspace(0, 3, 60)
    paths = np.concatenate([np.stack([x * np.exp(0.8 * t), y * np.exp(-0.8 * t)], 1) for x in (0.02, -0.02) for y in g[[0, -1]]])
    real, _ = K.jacobians(np.stack([0.02 * np.exp(0.8 * t), np.exp(-0.8 * t)], 1) + 1e-6 * np.random.default_rng(0).standard_normal((60, 2)))
    assert np.isfinite(real).all()
    sink = K.saddle_points(np.stack([np.exp(-t) * np.cos(2 * t), np.exp(-t) * np.sin(2 * t)], 1))
    assert (sink["kind"][10:50] == 0).mean() > 0.9 and sink["score"][10:50].max() < 0.2 and sink["basin_stability"][-1] > 0.8
    assert K.saddle(np.zeros(50))["saddle_score_mean"] != K.saddle(np.zeros(50))["saddle_score_mean"] and len(paths)


def test_growth_of_a_linear_map():
    r = np.random.default_rng(1)
    at = r.standard_normal((200, 2))
    after = at @ np.array([[2.0, 0.0], [0.0, 0.5]])
    assert K.stretch(np.zeros(2), at, after) == pytest.approx(math.log(2), abs=1e-9)
    f = K.field_between(np.array([-1.0, 0.0]), np.array([1.0, 0.0]), at, after)
    assert f["n_grid"] == 100 and f["ridge_strength"] == pytest.approx(math.log(2)) and f["corridor_width"] == 0 and f["ridge_width"] == pytest.approx(4)
    assert K.basin_depth(np.zeros(2), at, after)["basin_depth"] == pytest.approx(math.log(2))
    assert K.stretch(np.zeros(2), at[:2], after[:2]) == 0.0


def test_neighbours_in_blocks():
    x = np.random.default_rng(3).standard_normal((300, 3))
    for apart in (1, 4):
        d, j = K._neighbours(x, apart, block=37)
        full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        i = np.arange(300)
        full[np.abs(i[:, None] - i[None]) < apart] = np.inf
        assert (j == full.argmin(1)).all() and d == pytest.approx(full.min(1), rel=1e-5)


def test_rul_and_splits(spark):
    d = spark.createDataFrame([("a", t) for t in range(5)] + [("b", t) for t in range(3)], "cohort string, t int")
    assert [r.rul for r in X.with_rul(d, most=3).filter("cohort = 'a'").orderBy("t").collect()] == [3, 3, 2, 1, 0]
    life = spark.createDataFrame([("a", 9)], "cohort string, end int")
    got = X.with_rul(d, life=life).orderBy("cohort", "t").collect()
    assert [r.rul for r in got] == [9, 8, 7, 6, 5, None, None, None]
    both = X.split_union(d, d.withColumn("more", F.lit(1)))
    assert both.groupBy("split").count().count() == 2 and both.filter("split = 'train' and more is null").count() == 8


def test_regimes_learn_from_training_rows(spark):
    s = spark.createDataFrame([(f"u{i}", 0.0, float(i % 2) * 10, i < 6) for i in range(12)], "cohort string, signal_0 double, setting double, known boolean")
    o = s.select("cohort", F.lit("x").alias("signal_id"), "signal_0", (F.col("setting") + F.when(F.col("known"), F.col("signal_0")).otherwise(100.0) + F.hash("cohort") % 3).alias("value"))
    r = X.regime_normalised(o, s, ["cohort", "signal_0"], ["setting"], k=2, train=F.col("known"))
    a = r.join(s, ["cohort", "signal_0"]).groupBy("known", "regime").agg(F.avg("scaled").alias("m")).collect()
    assert all(abs(x.m) < 1e-9 for x in a if x.known) and all(x.m > 10 for x in a if not x.known)


def test_axes_do_not_reverse(spark):
    d = spark.createDataFrame([("c", 0, 1.0, 0.0), ("c", 1, -1.0, 0.1), ("c", 2, -0.9, -0.2), ("c", 3, 1.0, 0.0)], "cohort string, k int, pc_1 double, pc_2 double")
    r = G.continuous_axes(d, ("pc_1", "pc_2")).orderBy("k").collect()
    assert [x.pc_1 for x in r] == [1.0, 1.0, 0.9, 1.0] and [x.turned for x in r] == [False, True, True, False]
