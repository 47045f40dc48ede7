"""Count windows and running alarm sums over a stream of observations, with the batch kernels.

State is one series' last samples and sums. A sample at or before the last one seen is late: it comes out flagged and
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.registry import REGISTRY
from ..session import workers_import

CUSUM = "cohort string, signal_id string, signal_0 double, score double, late boolean"


def windowed(obs: DataFrame, engine: str, window: int, stride: int, watermark: str | None = None, time: str | None = None) -> DataFrame:
    """One row a completed window of a series, with the engine's outputs. Windows close in order of arrival within a batch
    sorted by signal_0."""
    workers_import(obs.sparkSession)
    e = REGISTRY[engine]
    outputs = ", ".join(f"{o} double" for o in e.outputs)
    schema = f"cohort string, signal_id string, k long, signal_0_end double, late boolean, {outputs}"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, ys = state.get if state.exists else (0, float("-inf"), [])
        rows = []
        for frame in frames:
            for t, v in frame.sort_values("signal_0")[["signal_0", "value"]].itertuples(index=False):
                if not t > last:
                    rows.append((*key, None, t, True, *[None] * len(e.outputs)))
                    continue
                seen, last, ys = seen + 1, t, [*ys, float(v)][-window:]
                if seen >= window and (seen - window) % stride == 0:
                    r = e.run(np.array(ys))
                    rows.append((*key, (seen - window) // stride, t, False, *(r[o] for o in e.outputs)))
        state.update((seen, last, ys))
        if rows:
            yield pd.DataFrame(rows, columns=["cohort", "signal_id", "k", "signal_0_end", "late", *e.outputs]).astype({"k": "Int64"})

    src = obs.withWatermark(time, watermark) if watermark and time else obs
    return src.groupBy("cohort", "signal_id").applyInPandasWithState(run, schema, "seen long, last double, ys array<double>", "append", GroupStateTimeout.NoTimeout)


def cusum(obs: DataFrame, noise: float, sensitivity: float = 1.0, alpha: float = 0.05, slack: float = 0.5) -> DataFrame:
    """An alarm each time a two-sided sum of departures from an exponential mean, in units of noise, passes 4 / sensitivity."""
    workers_import(obs.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, up, down, last = state.get if state.exists else (None, 0.0, 0.0, float("-inf"))
        rows = []
        for frame in frames:
            for t, v in frame.sort_values("signal_0")[["signal_0", "value"]].itertuples(index=False):
                if not t > last:
                    rows.append((*key, t, None, True))
                    continue
                last, mean = t, v if mean is None else mean
                z = (v - mean) / noise
                up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
                if max(up, down) > 4 / sensitivity:
                    rows.append((*key, t, max(up, down), False))
                    mean, up, down = v, 0.0, 0.0
                else:
                    mean = mean * (1 - alpha) + v * alpha
        state.update((mean, up, down, last))
        if rows:
            yield pd.DataFrame(rows, columns=["cohort", "signal_id", "signal_0", "score", "late"])

    return obs.groupBy("cohort", "signal_id").applyInPandasWithState(run, CUSUM, "mean double, up double, down double, last double", "append", GroupStateTimeout.NoTimeout)
