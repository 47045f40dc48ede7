"""The stage graph over one table of observations: named outputs, each a lazy plan over others.

    python -m orrery.plans.pipeline OBSERVATIONS OUT [--stages a,b] [--skip c,d] [--window 64] [--stride 32]

Stages are plans, so cohorts need no splitting, pooling or merging: the leading key of every exchange is the cohort.
Outputs that several stages read are written before they are read again. Fleet stages run if there are two cohorts.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import breaks as B
from ..operators import dynamics as D
from ..operators import engines as E
from ..operators import fleet as FL
from ..operators import geometry as G
from ..operators import kernel_ops as KO
from ..operators import normalize as N
from ..operators import pairs as P
from ..operators import registry as R
from ..operators import typology as T
from ..operators import validation as V
from ..sources import observations as O
from ..sources import units as UN

SHAPE = ["kurtosis", "skewness", "crest_factor"]
STATE = [f"state_{f}" for f in SHAPE]
FLEET = ("system_ftle", "system_information_flow", "system_vector", "system_geometry", "system_pairwise", "system_velocity_field", "trajectory_signatures", "trajectory_match", "trajectory_library")


class Job:
    """Stages by name over (observations, window, stride); each is built once and reads the others by name."""

    def __init__(self, obs: DataFrame, window: int = 64, stride: int = 32, manifest: R.Manifest | None = None):
        self.obs, self.window, self.stride = O.normalise(obs), window, stride
        self.manifest = manifest or R.Manifest(window, stride, {"*": {"*": ("statistics", "trend", "spectral", "memory", "complexity", "snr")}})
        self.made: dict[str, DataFrame] = {}
        self.needs: dict[str, set[str]] = {}
        self._building: list[str] = []

    def __getitem__(self, name: str) -> DataFrame:
        if self._building:
            self.needs.setdefault(self._building[-1], set()).add(name)
        if name not in self.made:
            self._building.append(name)
            try:
                self.made[name] = STAGES[name](self)
            finally:
                self._building.pop()
        return self.made[name]

    def rows(self, *lags: int) -> DataFrame:
        return W.hop(E.lagged(self.obs, *lags), self.window, self.stride)

    def cloud(self) -> DataFrame:
        r = self.rows()
        ends = r.groupBy(*E.KEYS).agg(F.max("signal_0").alias("signal_0_end"))
        return E.statistics(r).join(E.trend(r).select(*E.KEYS, "trend_slope", "detrend_std"), list(E.KEYS)).join(ends, list(E.KEYS))


def _geometry(job: Job) -> DataFrame:
    c = job.cloud()
    ends = c.groupBy("cohort", "k").agg(F.max("signal_0_end").alias("signal_0_end"))
    return KO.cohort_geometry(c, SHAPE, "shape").join(ends, ["cohort", "k"])


def _states(job: Job) -> DataFrame:
    c = job.cloud()
    return G.centroid(c, SHAPE).join(c.groupBy("cohort", "k").agg(F.max("signal_0_end").alias("signal_0_end")), ["cohort", "k"])


def _system(job: Job) -> DataFrame:
    s = job["cohort_vector"]
    long = s.unpivot(["cohort", "k"], STATE, "signal_id", "value")
    return D.velocity_field(long.select("cohort", "signal_id", F.col("k").cast("double").alias("signal_0"), "value"))


def _positions(job: Job) -> DataFrame:
    c = job.cloud()
    return G.positions(c, G.eigen3(c, SHAPE), SHAPE)


def _gated(job: Job) -> DataFrame:
    """Only pairs that ever co-load are aligned and go on to the costly kernels; if none does, all do."""
    tail = V.tail(job.obs)
    load = G.pairwise(job["cohort_signal_positions"], ["pc1_loading"], loading="pc1_loading").filter("needs_granger").select("cohort", "signal_a", "signal_b").distinct()
    return KO.information_flow(P.aligned(tail, None if load.isEmpty() else load))


def _fleet_series(job: Job) -> DataFrame:
    """Each cohort's effective dimension as a signal of one fleet."""
    g = job["cohort_geometry"].filter("effective_dim is not null")
    return g.select(F.lit("fleet").alias("cohort"), F.col("cohort").alias("signal_id"), F.col("k").cast("double").alias("signal_0"), F.col("effective_dim").alias("value"))


def _fleet_flow(job: Job) -> DataFrame:
    """Coupling of cohorts: the gate is their co-loading on the fleet's leading axis, cohorts that it does not know pass."""
    s = job["cohort_vector"].withColumnRenamed("cohort", "signal_id")
    p = G.positions(s, G.eigen3(s, STATE, keys=("k",)), STATE, keys=("k",))
    load = G.pairwise(p, ["pc1_loading"], keys=("k",), loading="pc1_loading", gate=0.3).filter("needs_granger").select(F.lit("fleet").alias("cohort"), "signal_a", "signal_b").distinct()
    return KO.information_flow(P.aligned(_fleet_series(job), None if load.isEmpty() else load), least=20).withColumnsRenamed({"signal_a": "cohort_a", "signal_b": "cohort_b"}).drop("cohort")


STAGES: dict[str, Callable[[Job], DataFrame]] = {
    "typology_windows": lambda j: T.window_metrics(j.rows(1)),
    "typology_vector": lambda j: T.vector(j["typology_windows"], ["kurtosis", "cv", "trend_strength", "perm_entropy"]),
    "breaks": lambda j: KO.breaks(j.obs),
    "break_summary": lambda j: B.summary(j["breaks"]),
    "signal_statistics": lambda j: N.statistics(j.obs),
    "signal_vector": lambda j: R.signal_vector(j.obs, j.manifest),
    "cohort_vector": _states,
    "cohort_geometry": _geometry,
    "cohort_signal_positions": _positions,
    "signal_dominance": lambda j: G.dominance(j["cohort_signal_positions"].withColumn("engine", F.lit("shape"))),
    "signal_geometry": lambda j: G.signal_geometry(j.cloud(), SHAPE),
    "cohort_pairwise": lambda j: G.pairwise(j.cloud(), SHAPE),
    "geometry_dynamics": lambda j: G.dynamics(j["cohort_geometry"].filter("effective_dim is not null")),
    "collapse": lambda j: G.collapse(j["geometry_dynamics"]),
    "thermodynamics": lambda j: G.thermodynamics(j["geometry_dynamics"]),
    "ftle": lambda j: KO.ftle(V.tail(j.obs), event=j.manifest.event),
    "ftle_backward": lambda j: KO.ftle(V.tail(j.obs), "backward", j.manifest.event),
    "lyapunov": lambda j: KO.lyapunov(V.tail(j.obs)),
    "velocity_field": lambda j: D.velocity_field(j.obs),
    "ftle_rolling": lambda j: KO.ftle_rolling(j.obs),
    "ridge_proximity": lambda j: D.ridge_proximity(j["ftle_rolling"].select("cohort", "signal_id", "signal_0_end", "ftle"), j["velocity_field"].withColumnRenamed("signal_0", "signal_0_end")),
    "signal_stability": lambda j: KO.signal_stability(j.obs),
    "persistent_homology": lambda j: KO.persistent_homology(j["cohort_vector"].withColumn("t", F.col("k").cast("double")), STATE),
    "ftle_field": lambda j: KO.ftle_field(j["cohort_vector"].withColumn("t", F.col("k").cast("double")), STATE),
    "saddles": lambda j: KO.saddles(j.obs),
    "information_flow": _gated,
    "system_vector": lambda j: G.centroid(j["cohort_vector"], STATE, keys=("k",)),
    "system_geometry": lambda j: G.effective_dim(j["cohort_vector"], STATE, keys=("k",)),
    "system_pairwise": lambda j: G.pairwise(j["cohort_vector"], STATE, keys=("k",), member="cohort"),
    "system_velocity_field": _system,
    "system_ftle": lambda j: KO.cohort_ftle(j["cohort_geometry"].filter("effective_dim is not null")),
    "system_information_flow": _fleet_flow,
    "trajectory_signatures": lambda j: FL.signatures(j["cohort_geometry"]),
    "trajectory_match": lambda j: FL.match(j["cohort_geometry"], j["cohort_geometry"]),
    "trajectory_library": lambda j: KO.trajectory_library(j["cohort_geometry"].filter("effective_dim is not null"), ["effective_dim", "total_variance"]),
}


#: What each stage reads of the others; the tests hold it against what building them reads.
NEEDS: dict[str, tuple[str, ...]] = {s: () for s in STAGES} | {
    "typology_vector": ("typology_windows",), "break_summary": ("breaks",), "signal_dominance": ("cohort_signal_positions",), "geometry_dynamics": ("cohort_geometry",), "collapse": ("geometry_dynamics",),
    "thermodynamics": ("geometry_dynamics",), "ridge_proximity": ("ftle_rolling", "velocity_field"), "persistent_homology": ("cohort_vector",), "ftle_field": ("cohort_vector",), "information_flow": ("cohort_signal_positions",),
    "system_vector": ("cohort_vector",), "system_geometry": ("cohort_vector",), "system_pairwise": ("cohort_vector",), "system_velocity_field": ("cohort_vector",), "system_ftle": ("cohort_geometry",),
    "system_information_flow": ("cohort_vector", "cohort_geometry"), "trajectory_signatures": ("cohort_geometry",), "trajectory_match": ("cohort_geometry",), "trajectory_library": ("cohort_geometry",),
}


def run(spark: SparkSession, obs: DataFrame, out: str, stages: list[str] | None = None, skip: tuple[str, ...] = (), **how) -> list[str]:
    """Write the stages (all, or those named) below out and return their names, in the order of the graph."""
    job = Job(obs, **how)
    alone = job.obs.select("cohort").distinct().limit(2).count() < 2
    done = []
    for name in STAGES:
        if name in skip or stages is not None and name not in stages or alone and name in FLEET:
            continue
        O.write_output(job[name], out, name, UN.units_of(name, job.manifest.unit))
        job.made[name] = spark.read.parquet(f"{out}/{name}")
        done.append(name)
    if done:
        UN.write_description(spark, out, done)
    return done


def main(argv: list[str] | None = None) -> None:
    from ..session import builder

    p = argparse.ArgumentParser(prog="orrery", description="Run the stage graph over a table of observations.")
    p.add_argument("observations")
    p.add_argument("out")
    p.add_argument("--manifest")
    p.add_argument("--stages")
    p.add_argument("--skip", default="")
    p.add_argument("--window", type=int, default=64)
    p.add_argument("--stride", type=int, default=32)
    a = p.parse_args(argv)
    spark = builder("orrery").getOrCreate()
    m = R.Manifest.load(a.manifest) if a.manifest else None
    window, stride = (m.window, m.stride) if m else (a.window, a.stride)
    done = run(spark, O.read_observations(spark, a.observations), a.out, a.stages.split(",") if a.stages else None, tuple(filter(None, a.skip.split(","))), window=window, stride=stride, manifest=m)
    print("\n".join(done))


if __name__ == "__main__":
    main()
