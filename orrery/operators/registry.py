"""Engines by name, the job's manifest, and the plan that runs a manifest over observations.

An engine is a function of one window's samples with declared outputs. The planner coalesces engines that look back
equally far, so each slice of a series is taken once, and runs all of a series' windows in one Arrow call.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import window_kernels as M
from ..session import workers_import


@dataclasses.dataclass(frozen=True)
class Engine:
    name: str
    run: Callable[[np.ndarray], dict]
    outputs: tuple[str, ...]
    base: int = 64
    least: int = 16
    most: int = 512
    scaling: str = "linear"

    def window(self, factor: float = 1.0) -> int:
        """Base window times f(factor), kept within the engine's limits."""
        f = {"linear": factor, "sqrt": math.sqrt(max(factor, 0)), "log": math.log2(1 + max(factor, 0))}[self.scaling]
        return int(min(max(round(self.base * f), self.least), self.most))


REGISTRY: dict[str, Engine] = {}


def register(name: str, run: Callable, base: int = 64, least: int = 16, most: int = 512, scaling: str = "linear") -> Engine:
    """The outputs are what the engine returns for noise. An output may belong to several engines only if they mean the
    same by it: `same` lists them."""
    probe = run(np.random.RandomState(0).standard_normal(256))
    probe = probe if isinstance(probe, dict) else {name: probe}
    call = run if isinstance(run(np.arange(4.0) % 2), dict) else (lambda y, f=run, n=name: {n: f(y)})
    for other in REGISTRY.values():
        shared = set(other.outputs).intersection(probe) - {o for o in probe if same(other, call, o)}
        if shared:
            raise ValueError(f"{name} and {other.name} mean different things by {', '.join(sorted(shared))}")
    REGISTRY[name] = Engine(name, call, tuple(probe), base, least, most, scaling)
    return REGISTRY[name]


def same(engine: Engine, run: Callable, output: str) -> bool:
    """Whether both give the same number under the same name."""
    for seed in (1, 2):
        y = np.cumsum(np.random.RandomState(seed).standard_normal(160))
        a, b = engine.run(y).get(output, math.nan), run(y).get(output, math.nan)
        if not (a == b or math.isnan(a) and math.isnan(b)):
            return False
    return True


def _lyapunov(y):
    r = K.lyapunov(y)
    return {"lyapunov": r["lyapunov"], "lyapunov_confidence": r["confidence"]}


def _never(*names):
    return lambda y: dict.fromkeys(names, K.NAN)


_permutation = lambda y: {"permutation_entropy": K.permutation_entropy(y)}

for _n, _f, _b, _l, _m, _s in (
    ("statistics", M.basic, 16, 4, 256, "linear"), ("trend", M.trend, 32, 8, 256, "linear"), ("memory", K.hurst, 48, 22, 256, "linear"), ("dfa", K.dfa, 48, 20, 256, "linear"), ("complexity", K.complexity, 64, 32, 256, "sqrt"),
    ("spectral", K.spectral, 64, 32, 512, "linear"), ("frequency_bands", K.frequency_bands, 64, 32, 512, "linear"), ("harmonics", K.harmonics, 64, 32, 512, "linear"), ("snr", K.snr, 32, 16, 256, "linear"),
    ("phase_coherence", K.phase_coherence, 32, 16, 256, "linear"), ("envelope", K.envelope, 32, 16, 256, "linear"), ("hilbert_stability", K.hilbert_stability, 16, 10, 512, "linear"), ("wavelet_stability", K.wavelet_stability, 16, 10, 512, "linear"),
    ("adf_stat", K.adf, 64, 20, 256, "linear"), ("lyapunov", _lyapunov, 128, 64, 512, "linear"), ("attractor", K.attractor, 128, 100, 512, "linear"), ("rqa", K.rqa, 64, 50, 512, "linear"), ("dmd", K.dmd, 64, 32, 512, "linear"), ("lof", K.lof, 32, 20, 512, "linear"),
    # without a model to fit, these two have nothing to say; their columns are there for those who expect them
    ("garch", _never("garch_omega", "garch_alpha", "garch_beta", "garch_persistence"), 64, 32, 512, "linear"),
    ("hmm", _never("hmm_n_states", "hmm_current_state", "hmm_state_prob", "hmm_entropy", "hmm_transition_rate", "hmm_bic", "hmm_log_likelihood"), 128, 30, 1024, "linear"),
    # those that are plans elsewhere
    ("variance_growth", M.variance_growth, 32, 16, 256, "linear"), ("variance_ratio", M.variance_ratio, 64, 20, 256, "linear"), ("rate_of_change", M.relative_change, 16, 4, 128, "linear"), ("rate_of_change_detailed", M.change, 16, 4, 128, "linear"),
    ("acf_decay", M.acf_decay, 22, 22, 256, "linear"), ("mann_kendall", M.mann_kendall, 16, 10, 256, "linear"), ("basin", M.basin, 128, 100, 512, "linear"), ("cycle_counting", M.cycle_counting, 16, 16, 512, "linear"),
    ("pulsation_index", M.pulsation, 8, 8, 512, "linear"), ("time_constant", M.time_constant, 16, 16, 512, "linear"), ("peak", M.peak, 4, 2, 1024, "linear"), ("rms", M.rms, 4, 2, 1024, "linear"),
    ("level_count", M.only(M.level_measures, *M.LEVEL_COUNT), 16, 4, 512, "linear"), ("level_histogram", M.only(M.level_measures, *M.LEVEL_HISTOGRAM), 16, 4, 512, "linear"), ("duty_cycle", M.only(M.level_measures, *M.DUTY), 16, 4, 512, "linear"),
    ("transition_matrix", M.only(M.transitions, *M.TRANSITIONS), 16, 4, 512, "linear"), ("transition_count", M.only(M.transitions, "transition_count"), 16, 4, 512, "linear"), ("entropy", M.raw_entropy, 16, 4, 512, "linear"),
    ("dwell_times", M.dwell_times, 16, 4, 512, "linear"), ("mean_time_between", M.mean_time_between, 16, 4, 512, "linear"),
    # single outputs of the above
    *((n, M.only(M.basic, n), 4, 4, 256, "linear") for n in ("kurtosis", "skewness", "crest_factor")), ("hurst", K.hurst, 48, 22, 256, "linear"), ("sample_entropy", lambda y: {"sample_entropy": K.sample_entropy(y)}, 64, 32, 256, "sqrt"),
    ("permutation_entropy", _permutation, 20, 20, 256, "linear"), ("perm_entropy", _permutation, 20, 20, 256, "linear"), ("approximate_entropy", lambda y: {"approximate_entropy": K.approximate_entropy(y)}, 30, 30, 256, "sqrt"),
    ("trend_r2", M.trend, 32, 8, 256, "linear"), ("detrend_std", M.trend, 32, 8, 256, "linear"), ("cusum", M.trend, 32, 8, 256, "linear"), ("spectral_entropy", K.spectral, 64, 32, 512, "linear"), ("band_power", K.frequency_bands, 64, 32, 512, "linear"),
    ("fundamental_freq", M.fundamental_freq, 64, 32, 512, "linear"), ("thd", M.thd, 64, 32, 512, "linear"), ("harmonic_ratio", M.only(K.harmonics, "harmonic_ratio"), 64, 32, 512, "linear"), ("recurrence_rate", M.recurrence_rate, 64, 30, 512, "linear"),
    ("determinism", M.determinism, 64, 30, 512, "linear"), ("correlation_dimension", M.correlation_dimension, 128, 64, 512, "linear"), ("embedding_dim", M.embedding_dim, 128, 64, 512, "linear"),
):
    register(_n, _f, _b, _l, _m, _s)

#: These need their least number of samples only; all others a full look-back.
RELAXED = frozenset("hurst recurrence_rate determinism correlation_dimension embedding_dim lyapunov".split())


class ManifestError(ValueError):
    """A job description that cannot be run."""


@dataclasses.dataclass(frozen=True)
class Manifest:
    window: int
    stride: int
    engines: dict[str, dict[str, tuple[str, ...]]]  # cohort -> signal -> engines
    windows: dict[str, int] = dataclasses.field(default_factory=dict)
    overrides: dict[tuple[str, str], dict[str, int]] = dataclasses.field(default_factory=dict)
    event: float | None = None
    unit: str = ""

    @classmethod
    def parse(cls, spec: dict) -> Manifest:
        system, cohorts = spec.get("system") or {}, spec.get("cohorts")
        missing = [n for n, ok in (("system.window", "window" in system), ("system.stride", "stride" in system), ("cohorts", bool(cohorts))) if not ok]
        if missing:
            raise ManifestError("missing: " + ", ".join(missing))
        engines = {c: {s: tuple(d.get("engines", ())) for s, d in signals.items()} for c, signals in cohorts.items()}
        over = {(c, s): dict(d["engine_window_overrides"]) for c, signals in cohorts.items() for s, d in signals.items() if d.get("engine_window_overrides")}
        hit = spec.get("intervention") or {}
        event = float(hit["event_index"]) if hit.get("enabled") and "event_index" in hit else None
        return cls(int(system["window"]), int(system["stride"]), engines, dict(spec.get("engine_windows") or {}), over, event, str((spec.get("signal_0") or {}).get("unit", "")))

    @classmethod
    def load(cls, path: str) -> Manifest:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.parse(yaml.safe_load(f) or {})

    def look_back(self, cohort: str, signal: str, engine: str, factor: float = 1.0) -> int:
        """A signal's own override, else the job's, else the engine's."""
        own = self.overrides.get((cohort, signal), {})
        return int(own.get(engine) or self.windows.get(engine) or REGISTRY[engine].window(factor))

    def audit(self) -> dict[str, list[str]]:
        asked = {e for signals in self.engines.values() for es in signals.values() for e in es}
        return {"available": sorted(asked & REGISTRY.keys()), "missing": sorted(asked - REGISTRY.keys())}


def columns_of(names: list[str]) -> dict[str, dict[str, str]]:
    """Column of each engine's outputs. Engines that share an output may look back differently: the first keeps the
    plain name, the others put theirs in front."""
    taken: set[str] = set()
    out: dict[str, dict[str, str]] = {}
    for n in names:
        out[n] = {o: o if o not in taken else f"{n}_{o}" for o in REGISTRY[n].outputs}
        taken.update(out[n].values())
    return out


def skipped(rules: dict[str, dict], metrics: dict[str, float | None]) -> bool:
    """Whether a gate keeps an engine from a window: a metric over its gt_skip or under its lt_skip, or fewer samples than
    min_obs. A missing metric never does."""
    for metric, rule in rules.items():
        v = metrics.get(metric)
        if v is not None and np.isfinite(v) and (rule.get("gt_skip") is not None and v > rule["gt_skip"] or rule.get("lt_skip") is not None and v < rule["lt_skip"]):
            return True
        n = metrics.get("n_obs")
        if rule.get("min_obs") is not None and n is not None and n < rule["min_obs"]:
            return True
    return False


def signal_vector(obs: DataFrame, manifest: Manifest, factors: dict[str, float] | None = None, gates: dict[str, dict[str, dict]] | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """One row a (cohort, signal_id, window end): coordinates, engine_mask (bit i: the i-th registered engine had samples
    enough, passed its gates and ran), and all registered outputs asked for; NULL where undefined or infinite.

    factors: window factor of a signal. gates: rules of an engine by metric of `metrics`, a table of (cohort, signal_id, k,
    metrics) with a row for each window. Each series is one Arrow call; its size is the series', so series far beyond
    memory must be cut before.
    """
    workers_import(obs.sparkSession)
    order = {n: i for i, n in enumerate(REGISTRY)}
    names = sorted(manifest.audit()["available"], key=order.__getitem__)
    column = columns_of(names)
    columns = list(dict.fromkeys(c for n in names for c in column[n].values()))
    fields = [("cohort", T.StringType()), ("signal_id", T.StringType()), ("signal_0_start", T.DoubleType()), ("signal_0_end", T.DoubleType()), ("signal_0_center", T.DoubleType()), ("engine_mask", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(c, T.DoubleType()) for c in columns])
    engines, kinds = dict(REGISTRY), [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def run(table: pa.Table, said: dict[int, dict] | None = None) -> pa.Table:
        cohort, signal = table.column("cohort")[0].as_py(), table.column("signal_id")[0].as_py()
        at = np.argsort(table.column("signal_0").to_numpy(), kind="stable")
        t, y = table.column("signal_0").to_numpy()[at], table.column("value").to_numpy(zero_copy_only=False).astype(float)[at]
        asked = manifest.engines.get(cohort, {}).get(signal, manifest.engines.get(cohort, {}).get("*", manifest.engines.get("*", {}).get("*", ())))
        by_look: dict[int, list[str]] = {}
        for e in asked:
            if e in engines:
                by_look.setdefault(manifest.look_back(cohort, signal, e, (factors or {}).get(signal, 1.0)), []).append(e)
        out: dict[str, list] = {f.name: [] for f in schema}
        for k, end in enumerate(range(manifest.window - 1, len(y), manifest.stride)):
            row, mask = {}, 0
            for look, es in by_look.items():
                x = y[max(0, end - look + 1) : end + 1]
                finite = int(np.isfinite(x).sum())
                for e in es:
                    if finite < engines[e].least or e not in RELAXED and len(x) < look or gates and skipped(gates.get(e, {}), (said or {}).get(k, {})):
                        continue
                    row |= {column[e][o]: v for o, v in engines[e].run(x).items()}
                    mask |= 1 << order[e]
            start = t[end - manifest.window + 1]
            for c, v in zip(list(out)[:6], (cohort, signal, start, t[end], (start + t[end]) / 2, mask), strict=True):
                out[c].append(v)
            for c in columns:
                v = row.get(c)
                out[c].append(float(v) if v is not None and np.isfinite(v) else None)
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), [*kinds, *[pa.float64()] * len(columns)], strict=True)], names=[*out])

    keyed = obs.withColumn("cohort", F.coalesce("cohort", F.lit("_default"))).groupBy("cohort", "signal_id")
    if not gates or metrics is None:
        return keyed.applyInArrow(lambda t: run(t), schema)

    def gated(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema_table
        return run(left, {int(r["k"]): r for r in right.to_pylist()})

    schema_table = pa.table([pa.array([], k) for k in [*kinds, *[pa.float64()] * len(columns)]], names=schema.names)
    return keyed.cogroup(metrics.withColumn("cohort", F.coalesce("cohort", F.lit("_default"))).groupBy("cohort", "signal_id")).applyInArrow(gated, schema)
