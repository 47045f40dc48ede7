"""Times headline queries: one JSON line. $BENCH_SF_DIR (default /root/testdata/sf0.1), $BENCH_CPUS (default 8)."""

from __future__ import annotations

import contextlib
import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINE = [
    "flagship_effective_dim", "eng_statistics", "eng_trend", "eng_levels", "eng_transition_matrix", "typology_windows", "spectral_dft", "sig_statistics", "sig_mad_departure", "sig_correlation", "gauss_similarity",
    "breaks_full", "signal_vector", "cohort_geometry", "cohort_geometry_core", "signal_pairwise", "geometry_dynamics", "velocity_field", "ridge_proximity", "csd", "mutual_info", "transfer_entropy", "information_flow",
    "ftle", "ftle_rolling", "lyapunov", "signal_stability", "persistent_homology", "system_vector", "cohort_pairwise_fleet", "traj_match", "curve_features", "sensor_rolling", "thermodynamics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from orrery.plans import QUERIES
    from orrery.session import builder

    spark = builder("bench", **{"spark.master": f"local[{cpus}]", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    failed: dict[str, str] = {}
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session's code and workers
    for name in HEADLINE:
        try:
            at = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - at, 3)
        except Exception as e:  # a broken query must not hide the others' times
            failed[name] = str(e)[:200]
    with contextlib.suppress(Exception):
        spark.stop()
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    line = {"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir}
    print(json.dumps(line | ({"failed": failed} if failed else {})))


if __name__ == "__main__":
    main()
