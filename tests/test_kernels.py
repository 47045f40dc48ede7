"""Closed forms and bounds for the numeric kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.functions import kernels as K
from orrery.operators import registry as R

T = np.linspace(0, 1, 1000, endpoint=False)
SINE = np.sin(2 * np.pi * 10 * T)
NOISY = SINE + 0.5 * np.random.RandomState(42).standard_normal(1000)
NOISE = np.random.RandomState(7).standard_normal(600)


def logistic(n, x=0.4):
    out = []
    for _ in range(n):
        x = 4 * x * (1 - x)
        out.append(x)
    return np.array(out)


def test_sine_spectrum():
    s = K.spectral(SINE)
    assert s["dominant_freq"] * 1000 == pytest.approx(10)
    assert s["spectral_entropy"] < 0.01
    assert s["spectral_flatness"] < K.spectral(NOISY)["spectral_flatness"]


def test_constant_has_no_spectrum():
    assert K.spectral(np.ones(64))["dominant_freq"] == 0.0


def test_bands_of_a_low_tone():
    b = K.frequency_bands(SINE)
    assert b["band_low_rel"] > 0.99 and b["band_high_rel"] < 0.01


def test_harmonics_of_two_tones():
    y = SINE + 0.1 * np.sin(2 * np.pi * 20 * T)
    h = K.harmonics(y)
    assert h["thd_percent"] == pytest.approx(10, abs=0.1)
    assert h["harmonic_2x"] / h["fundamental_amplitude"] == pytest.approx(0.1, abs=1e-3)


def test_snr_falls_with_noise():
    assert K.snr(SINE)["snr_db"] > K.snr(NOISY)["snr_db"] > 0


def test_analytic_signal_of_a_sine_has_unit_envelope():
    e = np.abs(K.analytic(SINE))
    assert e == pytest.approx(np.ones(1000), abs=1e-6)
    assert K.hilbert_stability(SINE)["inst_freq_mean"] == pytest.approx(0.01, abs=1e-4)


def test_hurst_and_dfa_of_noise():
    assert 0.4 < K.hurst(NOISE)["hurst"] < 0.7
    assert 0.35 < K.dfa(NOISE)["dfa"] < 0.65
    assert K.dfa(np.cumsum(NOISE))["dfa"] > 1.2


def test_entropies_order_regular_before_random():
    assert K.permutation_entropy(np.arange(50.0)) == 0
    assert 0.9 < K.permutation_entropy(NOISE) <= 1
    assert K.sample_entropy(SINE[:300]) < K.sample_entropy(NOISE[:300])
    assert K.approximate_entropy(SINE[:300]) < K.approximate_entropy(NOISE[:300])


def test_sample_entropy_by_hand():
    y = np.array([1.0, 2, 1, 2, 1, 2, 1, 2])
    # templates of 2: pairs alike within the tolerance; all that match stay alike for 3
    assert K.sample_entropy(y) == pytest.approx(0.0)


def test_logistic_map_exponent():
    assert K.rosenstein(logistic(1500), 2, 1, 8)[0] == pytest.approx(math.log(2), abs=0.1)
    assert K.kantz(logistic(400), 2, 1, 0.02, 6) > 0.2


def test_henon_dimension():
    x, y, out = 0.1, 0.3, []
    for _ in range(900):
        x, y = 1 - 1.4 * x * x + y, 0.3 * x
        out.append(x)
    assert 0.9 < K.correlation_dimension(np.array(out), 2, 1) < 1.5
    assert K.optimal_dimension(np.array(out), 1) == 2


def test_ftle_short_series_is_undefined():
    r = K.ftle(NOISE[:40])
    assert math.isnan(r["ftle"]) and r["confidence"] == 0.0


def test_recurrence_of_a_periodic_signal_is_deterministic():
    p = K.rqa(np.sin(np.arange(120) * 2 * np.pi / 12.34))
    assert p["determinism"] > 0.9 > K.rqa(NOISE[:120])["determinism"]


def test_dmd_finds_a_decaying_tone():
    t = np.arange(120)
    r = K.dmd(np.exp(-0.02 * t) * np.cos(2 * np.pi * 0.1 * t))
    assert r["dmd_dominant_freq"] == pytest.approx(0.1, abs=0.01)
    assert r["dmd_growth_rate"] == pytest.approx(-0.02, abs=0.01)


def test_lof_flags_an_outlier():
    y = np.concatenate([NOISE[:80], [50.0]])
    assert K.lof(y)["lof_max"] > 5


def test_beta_and_f():
    assert K.beta_cdf(0.5, 2, 3) == pytest.approx(0.6875)
    assert K.f_survival(3.0, 2, 10) == pytest.approx(0.09536743, abs=1e-6)
    assert K.normal_cdf(1.959963985) == pytest.approx(0.975)


def test_adf_tells_noise_from_walk():
    assert K.adf(NOISE[:300])["adf_stat"] < -3.5
    assert K.adf(np.cumsum(NOISE[:300]))["adf_stat"] > -2.9
    assert K.adf(np.ones(50))["adf_stat"] == -math.inf


def test_granger_finds_the_cause():
    y = np.zeros(400)
    for i in range(1, 400):
        y[i] = 0.2 * y[i - 1] + 0.8 * NOISE[i - 1] + 0.3 * NOISE[-i]
    assert K.granger(NOISE[:400], y)["granger_p"] < 1e-6
    assert K.granger(y, NOISE[:400])["granger_p"] > 1e-3


def brute_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12), st.lists(st.integers(-5, 5), min_size=1, max_size=12))
def test_dtw_equals_the_full_table(a, b):
    assert K.dtw(a, b) == pytest.approx(brute_dtw(a, b))


def test_effective_dimension():
    x = np.random.RandomState(42).standard_normal((400, 5))
    assert K.eigen(x)["effective_dim"] > 4.8
    base = x[:, :1]
    near = base + 0.01 * x
    e = K.eigen(near)
    assert e["effective_dim"] < 1.1 and e["condition_number"] > 100
    for norm in ("robust", "mad", "none"):
        assert 1 <= K.eigen(x, norm)["effective_dim"] <= 5


def test_laplacian_counts_components():
    block = np.kron(np.eye(2), np.ones((3, 3)))
    assert K.laplacian_view(block)["n_components"] == 2


def test_circle_has_one_hole():
    a = np.linspace(0, 2 * np.pi, 16, endpoint=False)
    pairs = K.persistence(np.column_stack([np.cos(a), np.sin(a)]))
    assert len(pairs[0]) == 15 and len(pairs[1]) == 1
    assert pairs[1][0][1] - pairs[1][0][0] > 1


def test_savgol_keeps_cubics():
    t = np.arange(40.0)
    y = 0.01 * t**3 - t
    assert K.savgol(y) == pytest.approx(y, abs=1e-8)


def test_clusters_and_medoids():
    x = np.concatenate([np.arange(4.0), 100 + np.arange(4.0)])
    d = np.abs(x[:, None] - x[None])
    labels, medoids = K.cluster(d)
    assert labels.tolist() == [0] * 4 + [1] * 4 and len(medoids) == 2


def test_constant_and_short_inputs_never_raise():
    for e in R.REGISTRY.values():
        for y in (np.ones(128), np.zeros(3), np.full(20, np.nan), np.array([])):
            out = e.run(y)
            assert set(out) == set(e.outputs), e.name


def test_scale_invariance():
    for name in ("statistics", "memory", "complexity"):
        a, b = R.REGISTRY[name].run(NOISE[:200]), R.REGISTRY[name].run(NOISE[:200] * 7)
        for k in a:
            assert a[k] == pytest.approx(b[k], rel=1e-6), (name, k)


def test_copula_family_is_found():
    r = np.random.RandomState(6)
    # Clayton by conditional inversion, theta 4: tau 2/3, lower tail 2^(-1/4)
    u, w = r.uniform(size=700), r.uniform(size=700)
    v = ((w ** (-4 / 5) - 1) * u**-4.0 + 1) ** -0.25
    f = K.copula_fit(u, v)
    assert f["family"] == 1 and f["kendall"] == pytest.approx(2 / 3, abs=0.05) and f["lower"] == pytest.approx(2**-0.25, abs=0.05)
    z = r.multivariate_normal([0, 0], [[1, 0.7], [0.7, 1]], 700)
    assert K.copula_fit(z[:, 0], z[:, 1])["family"] == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.integers(0, 10**6))
def test_inversions(n, seed):
    p = np.random.RandomState(seed).permutation(n)
    assert K.inversions(p) == sum(int((p[:i] > p[i]).sum()) for i in range(n))


def test_frank_and_quantiles():
    assert K.frank_theta(0.5) == pytest.approx(5.736, abs=0.05)
    assert K.frank_theta(-0.5) == pytest.approx(-5.736, abs=0.05)
    assert K.normal_quantile(np.array([0.5, 0.975])) == pytest.approx([0, 1.959964], abs=1e-5)


def test_fingerprint_metrics():
    r = np.random.RandomState(1)
    free = K.window_metrics(r.standard_normal((8, 200)))
    base = r.standard_normal(200)
    tied = K.window_metrics(np.stack([base + 0.01 * r.standard_normal(200) for _ in range(8)]))
    assert len(free) == 18 and free["effective_dim"] > 4.8
    assert tied["effective_dim"] < 2 and tied["condition_number"] > 100 and tied["mean_abs_corr"] > 0.99


def test_settings_layers(tmp_path):
    from orrery.config import Settings

    (tmp_path / "a.yaml").write_text("x: {y: 1e-10, z: [1, 2]}\nw: 3\n")
    (tmp_path / "b.yaml").write_text("x: {z: [9]}\n")
    s = Settings.load(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), str(tmp_path / "none.yaml"))
    assert (s.get("x.y"), s.get("x.z"), s.get("w"), s.get("q.r", 5)) == (1e-10, [9], 3, 5)
