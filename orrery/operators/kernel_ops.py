"""Numeric kernels applied to groups through Arrow: series, windows of series, clouds and pairs."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import windows as W
from ..session import workers_import
from . import dynamics as D

SERIES = ("cohort", "signal_id")


def _schema(strings: list[str], numbers: list[str]) -> T.StructType:
    return T.StructType([T.StructField(s, T.StringType()) for s in strings] + [T.StructField(n, T.DoubleType()) for n in numbers])


def _table(rows: list[dict], strings: list[str], numbers: list[str]) -> pa.Table:
    number = lambda v: None if v is None or not np.isfinite(v) else float(v)
    cols = [pa.array([r[s] for r in rows], pa.string()) for s in strings] + [pa.array([number(r.get(n)) for r in rows], pa.float64()) for n in numbers]
    return pa.table(cols, names=[*strings, *numbers])


def _ordered(table: pa.Table, by: str, *columns: str) -> list[np.ndarray]:
    at = np.argsort(table.column(by).to_numpy(), kind="stable")
    return [table.column(c).to_numpy(zero_copy_only=False).astype(float)[at] for c in columns]


def spread(rows: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Rows dealt by keys over many parts a core, so that few share one. Long series are few and small on disk, so that adaptive execution would put
    many of them into one task; parts of a given number it leaves alone."""
    s = rows.sparkSession
    return rows.repartition(max(int(s.conf.get("spark.sql.shuffle.partitions")), 32 * s.sparkContext.defaultParallelism), *keys)


def per_series(obs: DataFrame, f: Callable[[np.ndarray], dict], outputs: list[str]) -> DataFrame:
    """f over each whole series."""
    workers_import(obs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        (y,) = _ordered(t, "signal_0", "value")
        return _table([{"cohort": t.column("cohort")[0].as_py(), "signal_id": t.column("signal_id")[0].as_py()} | f(y)], [*SERIES], outputs)

    return spread(obs).groupBy(*SERIES).applyInArrow(run, _schema([*SERIES], outputs))


CHUNK = 4096


def per_window(obs: DataFrame, f: Callable[[np.ndarray], dict], outputs: list[str], window: int, stride: int, chunk: int = CHUNK) -> DataFrame:
    """f over hop windows; `chunk` of a series' windows in one call, which gets the samples of these windows alone, so a
    series may be of any length. Null and NaN values do not count as samples. Short series give one window."""
    workers_import(obs.sparkSession)
    numbers = ["k", "signal_0_start", "signal_0_end", *outputs]
    rows = W.indexed(obs)
    # chunk c holds windows c * chunk and on: rows from c * chunk * stride, as long as its windows reach
    jump, reach = chunk * stride, (chunk - 1) * stride + window
    windows = F.greatest(F.floor((F.col("n") - window) / stride) + 1, F.lit(1))
    first = F.greatest(F.ceil((F.col("r") - reach + 1) / jump), F.lit(0))
    last = F.least(F.floor(F.col("r") / jump), F.floor((windows - 1) / chunk))
    rows = rows.withColumns({"__a": first.cast("int"), "__b": last.cast("int")}).filter("__a <= __b").withColumn("chunk", F.explode(F.sequence("__a", "__b")))
    rows = rows.select(*SERIES, "chunk", "r", "n", "signal_0", "value")

    def run(t: pa.Table) -> pa.Table:
        y, c = _ordered(t, "r", "value", "signal_0")
        key = {"cohort": t.column("cohort")[0].as_py(), "signal_id": t.column("signal_id")[0].as_py()}
        w, at, rows = min(window, t.column("n")[0].as_py()), t.column("chunk")[0].as_py() * chunk, []
        for k, end in enumerate(range(w - 1, len(y), stride)):
            if k < chunk:
                rows.append(key | {"k": at + k, "signal_0_start": c[end - w + 1], "signal_0_end": c[end]} | f(y[end - w + 1 : end + 1]))
        return _table(rows, [*SERIES], numbers)

    return rows.groupBy(*SERIES, "chunk").applyInArrow(run, _schema([*SERIES], numbers))


def rolling(obs: DataFrame, engine: Callable[[np.ndarray], dict], outputs: list[str], window: int) -> DataFrame:
    """An engine over the last `window` samples of every sample that has them: signal_0 and the outputs."""
    return per_window(obs.filter(F.col("value").isNotNull()), engine, outputs, window, 1).withColumnRenamed("signal_0_end", "signal_0").select(*SERIES, "signal_0", *outputs)


def rolling_named(name: str) -> Callable[[DataFrame, int], DataFrame]:
    """The rolling form of a registered engine."""

    def run(obs: DataFrame, window: int) -> DataFrame:
        from . import registry as R

        return rolling(obs, R.REGISTRY[name].run, list(R.REGISTRY[name].outputs), window)

    return run


rolling_statistics, rolling_memory, rolling_complexity, rolling_spectral, rolling_trend = map(rolling_named, ("statistics", "memory", "complexity", "spectral", "trend"))


FTLE = ["ftle", "ftle_std", "embedding_dim", "embedding_tau", "is_deterministic", "confidence", "n_samples"]


def ftle(obs: DataFrame, direction: str = "forward", event: float | None = None) -> DataFrame:
    """Exponent, embedding and stability class of each series; with an intervention also before, after and their difference."""
    out = FTLE if event is None else [*FTLE, "ftle_pre", "n_pre", "ftle_post", "n_post"]
    workers_import(obs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        y, c = _ordered(t, "signal_0", "value", "signal_0")
        r = {"cohort": t.column("cohort")[0].as_py(), "signal_id": t.column("signal_id")[0].as_py()} | K.ftle(y, direction)
        if event is not None:
            for name, side in (("pre", c < event), ("post", c >= event)):
                part = K.ftle(y[side], direction)
                r |= {f"ftle_{name}": part["ftle"], f"n_{name}": part["n_samples"]}
        return _table([r], [*SERIES], out)

    r = spread(obs).groupBy(*SERIES).applyInArrow(run, _schema([*SERIES], out))
    r = r.withColumn("direction", F.lit(direction)).withColumn("stability", D.stability_class(F.col("ftle")))
    if event is None:
        return r
    return r.withColumn("ftle_delta", F.col("ftle_post") - F.col("ftle_pre")).withColumn("event_index", F.lit(event))


def ftle_both(obs: DataFrame) -> DataFrame:
    return ftle(obs).unionByName(ftle(obs, "backward"))


def ftle_rolling(obs: DataFrame, window: int = 200, stride: int = 50) -> DataFrame:
    """Exponents of windows with the embedding of the first; velocity and acceleration are plain differences (0 at the ends)."""
    workers_import(obs.sparkSession)
    numbers = ["k", "signal_0_end", "ftle", "ftle_std", "confidence", "embedding_dim", "embedding_tau"]

    def run(t: pa.Table) -> pa.Table:
        y, c = _ordered(t, "signal_0", "value", "signal_0")
        w, rows, dim, tau = min(window, len(y)), [], None, None
        for k, end in enumerate(range(w - 1, len(y), stride)):
            r = K.ftle(y[end - w + 1 : end + 1], dim=dim, tau=tau)
            if dim is None and np.isfinite(r["embedding_dim"]):
                dim, tau = int(r["embedding_dim"]), int(r["embedding_tau"])
            rows.append({"cohort": t.column("cohort")[0].as_py(), "signal_id": t.column("signal_id")[0].as_py(), "k": k, "signal_0_end": c[end]} | r)
        return _table(rows, [*SERIES], numbers)

    r = obs.groupBy(*SERIES).applyInArrow(run, _schema([*SERIES], numbers))
    o = Window.partitionBy(*SERIES).orderBy("k")
    r = r.withColumn("ftle_velocity", F.coalesce(F.col("ftle") - F.lag("ftle").over(o), F.lit(0.0)))
    return r.withColumn("ftle_acceleration", F.coalesce(F.col("ftle_velocity") - F.lag("ftle_velocity").over(o), F.lit(0.0)))


LYAPUNOV = ["lyapunov", "embedding_dim", "embedding_tau", "confidence", "n_samples"]


def lyapunov(obs: DataFrame) -> DataFrame:
    return per_series(obs, K.lyapunov, LYAPUNOV)


def lyapunov_rolling(obs: DataFrame, window: int = 500, stride: int = 50) -> DataFrame:
    return per_window(obs, K.lyapunov, LYAPUNOV, window, stride)


def lyapunov_trend(rolled: DataFrame, least: int = 4) -> DataFrame:
    """Slope and fit of a series' rolling exponents on the window's number; NULL under `least` windows."""
    ok = F.count("lyapunov") >= least
    return rolled.groupBy(*SERIES).agg(F.when(ok, F.regr_slope("lyapunov", "k")).alias("lyapunov_slope"), F.when(ok, F.regr_r2("lyapunov", "k")).alias("lyapunov_r2"), F.count("lyapunov").alias("n_windows"))


def cohort_ftle(series: DataFrame, value: str = "effective_dim", order: str = "signal_0_end", least: int = 30) -> DataFrame:
    """Exponents of each cohort's windowed value, forward and backward; cohorts of fewer than `least` windows say so."""
    workers_import(series.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        (y,) = _ordered(t, order, value)
        rows = [{"cohort": t.column("cohort")[0].as_py(), "direction": d} | K.ftle(y, d, least=least) for d in ("forward", "backward")]
        return _table(rows, ["cohort", "direction"], FTLE)

    r = series.select("cohort", order, value).groupBy("cohort").applyInArrow(run, _schema(["cohort", "direction"], FTLE))
    kind = F.when(F.col("n_samples") < least, "INSUFFICIENT_DATA").otherwise(D.stability_class(F.col("ftle")))
    return r.withColumn("stability", kind)


SADDLE = list(K.saddle_summary(np.zeros((0, 2))))


def saddles(obs: DataFrame) -> DataFrame:
    """Saddle measures of every series in its own embedding."""
    return per_series(obs, K.saddle, [*SADDLE, "embedding_dim", "embedding_tau"])


def saddles_rolling(obs: DataFrame, window: int = 200, stride: int = 20) -> DataFrame:
    return per_window(obs, K.saddle, ["saddle_score_current", "basin_stability_current"], window, stride)


def path_saddles(path: DataFrame, columns: list[str], key: str = "cohort", order: str = "t") -> DataFrame:
    """Score, basin stability and distance to the separatrix of every point of a path through several columns."""
    workers_import(path.sparkSession)
    out = ["at", "score", "basin_stability", "separatrix_distance", "kind"]

    def run(t: pa.Table) -> pa.Table:
        x, at = np.column_stack(_ordered(t, order, *columns)), _ordered(t, order, order)[0]
        ok = np.isfinite(x).all(1)
        x, at = x[ok], at[ok]
        if len(x) < len(columns) + 5:
            return _table([], [key], out)
        r = K.saddle_points(x)
        return _table([{key: t.column(key)[0].as_py(), "at": at[i]} | {n: r[n][i] for n in out[1:]} for i in range(len(x))], [key], out)

    return path.groupBy(key).applyInArrow(run, _schema([key], out))


def cohort_geometry(cloud: DataFrame, features: list[str], engine: str = "all", norm: str = "zscore", keys: tuple[str, ...] = ("cohort", "k")) -> DataFrame:
    """Full spectrum of every cloud: five eigenvalues (0 beyond the features), shares, effective dimension, entropy, condition
    number, ratios. Rows with a missing feature are left out; a cloud of under two rows gives NULLs."""
    workers_import(cloud.sparkSession)
    numbers = ["k", "n_signals", *(f"eigenvalue_{i}" for i in range(1, 6)), *(f"explained_{i}" for i in range(1, 6)), "effective_dim", "total_variance", "eigenvalue_entropy", "eigenvalue_entropy_norm", "condition_number", "ratio_2_1", "ratio_3_1"]

    def run(t: pa.Table) -> pa.Table:
        x = np.column_stack([t.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
        r = {"cohort": t.column("cohort")[0].as_py(), "engine": engine, "k": t.column("k")[0].as_py(), "n_signals": len(x)}
        if e := K.eigen(x, norm):
            lam = np.concatenate([e["values"], np.zeros(5)])[:5]
            q = np.concatenate([e["explained"], np.zeros(5)])[:5]
            r |= {f"eigenvalue_{i + 1}": v for i, v in enumerate(lam)} | {f"explained_{i + 1}": v for i, v in enumerate(q)}
            r |= {"effective_dim": e["effective_dim"], "total_variance": e["total_variance"], "eigenvalue_entropy": e["entropy"], "eigenvalue_entropy_norm": e["entropy_norm"], "condition_number": e["condition_number"], "ratio_2_1": lam[1] / lam[0] if lam[0] > 0 else None, "ratio_3_1": lam[2] / lam[0] if lam[0] > 0 else None}
        return _table([r], ["cohort", "engine"], numbers)

    return cloud.select(*keys, *features).groupBy(*keys).applyInArrow(run, _schema(["cohort", "engine"], numbers))


def eigenvector_flips(positions: DataFrame) -> DataFrame:
    """Per cohort: windows whose leading axis turns over against the window before (negative product of loadings)."""
    o = Window.partitionBy("cohort", "signal_id").orderBy("k")
    p = positions.withColumn("dot", F.col("pc1_loading") * F.lag("pc1_loading").over(o))
    w = p.groupBy("cohort", "k").agg(F.sum("dot").alias("dot"))
    return w.groupBy("cohort").agg(F.sum((F.col("dot") < 0).cast("int")).alias("eigenvector_flip_count"), F.count("*").alias("n_windows"))


def laplacian(obs: DataFrame, window: int = 64, stride: int = 32) -> DataFrame:
    """Laplacian view of the correlation graph of a cohort's signals, window by window."""
    workers_import(obs.sparkSession)
    numbers = ["k", "algebraic_connectivity", "spectral_gap", "n_components", "laplacian_max"]

    def run(t: pa.Table) -> pa.Table:
        wide = t.to_pandas().pivot_table(index="signal_0", columns="signal_id", values="value").sort_index().interpolate().ffill().bfill().to_numpy()
        rows = []
        for k, end in enumerate(range(min(window, len(wide)) - 1, len(wide), stride)):
            x = wide[max(0, end - window + 1) : end + 1]
            with np.errstate(all="ignore"):
                rows.append({"cohort": t.column("cohort")[0].as_py(), "k": k} | K.laplacian_view(np.corrcoef(x, rowvar=False)))
        return _table(rows, ["cohort"], numbers)

    return obs.groupBy("cohort").applyInArrow(run, _schema(["cohort"], numbers))


def persistent_homology(path: DataFrame, columns: list[str], window: int = 20, stride: int = 5) -> DataFrame:
    """Topology of windows of a cohort's path. path: cohort, t, columns."""
    workers_import(path.sparkSession)
    out = [f"{n}_{k}" for k in (0, 1) for n in ("betti", "persistence_entropy", "max_persistence", "total_persistence")]

    def run(t: pa.Table) -> pa.Table:
        x = np.column_stack(_ordered(t, "t", *columns))
        x = x[np.isfinite(x).all(1)]
        rows = []
        for k, end in enumerate(range(min(window, len(x)) - 1, len(x), stride)):
            rows.append({"cohort": t.column("cohort")[0].as_py(), "k": k} | K.persistence_summary(x[max(0, end - window + 1) : end + 1]))
        return _table(rows, ["cohort"], ["k", *out])

    return path.groupBy("cohort").applyInArrow(run, _schema(["cohort"], ["k", *out]))


PAIR_OUT = ["n_samples", "granger_f_ab", "granger_p_ab", "granger_f_ba", "granger_p_ba", "dtw", "adf_stat", "adf_pvalue", "is_cointegrated", "half_life"]


def information_flow(pairs: DataFrame, least: int = 100) -> DataFrame:
    """The costly pair numbers of (cohort, signal_a, signal_b, t, x, y): Granger both ways, warping, cointegration, over all
    samples of a pair (cut series before, as the stage does, to bound the warping, which is quadratic)."""
    workers_import(pairs.sparkSession)
    keys = ["cohort", "signal_a", "signal_b"]

    def run(t: pa.Table) -> pa.Table:
        x, y = _ordered(t, "t", "x", "y")
        r = {k: t.column(k)[0].as_py() for k in keys} | {"n_samples": len(x)}
        if len(x) >= least:
            ab, ba = K.granger(x, y), K.granger(y, x)
            b, a = np.polyfit(x, y, 1) if x.std() > 1e-12 else (0.0, y.mean())
            e = y - a - b * x
            z = K.adf(e, 4)
            phi = np.polyfit(e[:-1], e[1:], 1)[0] if e.std() > 1e-12 else 0.0
            zs = lambda v: (v - v.mean()) / (v.std() or 1)
            r |= {"granger_f_ab": ab["granger_f"], "granger_p_ab": ab["granger_p"], "granger_f_ba": ba["granger_f"], "granger_p_ba": ba["granger_p"], "dtw": K.dtw(zs(x), zs(y)), "adf_stat": z["adf_stat"], "adf_pvalue": z["adf_pvalue"], "is_cointegrated": float(z["adf_stat"] < -3.34), "half_life": -np.log(2) / np.log(phi) if 0 < phi < 1 else None}
        return _table([r], keys, PAIR_OUT)

    return spread(pairs, keys).groupBy(*keys).applyInArrow(run, _schema(keys, PAIR_OUT))


HILBERT, WAVELET = list(K.hilbert_stability(np.zeros(3))), list(K.wavelet_stability(np.zeros(3)))


def signal_stability(obs: DataFrame, window: int = 30, stride: int = 5) -> DataFrame:
    """Hilbert and spectral steadiness of every window, then mean, deviation, least and greatest over a cohort's signals;
    undefined values are left out of them."""
    w = per_window(obs, lambda y: K.hilbert_stability(y) | K.wavelet_stability(y), [*HILBERT, *WAVELET], window, stride)
    aggs = [f(n).alias(f"{n}_{k}") for n in (*HILBERT, *WAVELET) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return w.groupBy("cohort", "k").agg(F.count("*").alias("n_signals"), *aggs)


def trajectory_library(series: DataFrame, columns: list[str], key: str = "cohort", order: str = "signal_0_end", most: int = 6) -> DataFrame:
    """Distances of cohorts' paths by warping, Ward clusters of best silhouette, medoids. Work on cohorts, which are few: their
    distance matrix goes to one task."""
    workers_import(series.sparkSession)
    one = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("path")).withColumn("all", F.lit(1))
    schema = _schema([key], ["trajectory_id", "is_medoid", "distance_to_medoid"])

    def run(t: pa.Table) -> pa.Table:
        names = t.column(key).to_pylist()
        paths = [np.array([[p[c] for c in columns] for p in path], float) for path in t.column("path").to_pylist()]
        n = int(np.median([len(p) for p in paths]))
        sd = np.concatenate(paths).std(0)
        z = [np.column_stack([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(p)), p[:, c] / (sd[c] if sd[c] > 1e-10 else 1)) for c in range(p.shape[1])]) for p in paths]
        d = np.zeros((len(z), len(z)))
        for i, j in itertools.combinations(range(len(z)), 2):
            d[i, j] = d[j, i] = np.mean([K.dtw(z[i][:, c], z[j][:, c]) / n for c in range(len(columns))])
        labels, medoids = K.cluster(d, most)
        return _table([{key: x, "trajectory_id": labels[i], "is_medoid": float(i in medoids), "distance_to_medoid": d[i, medoids[labels[i]]]} for i, x in enumerate(names)], [key], ["trajectory_id", "is_medoid", "distance_to_medoid"])

    return one.groupBy("all").applyInArrow(run, schema)


def ftle_field(path: DataFrame, columns: list[str], key: str = "cohort", order: str = "t") -> DataFrame:
    """Local growth rates along each cohort's path: mean, ridge (greatest) and its place, and how wide it is at half height."""
    workers_import(path.sparkSession)
    out = ["mean_ftle", "ridge_strength", "ridge_at", "ridge_width", "saddle_score", "rate_product"]

    def run(t: pa.Table) -> pa.Table:
        x = np.column_stack(_ordered(t, order, *columns))
        x = x[np.isfinite(x).all(1)]
        f = K.point_ftle(x)
        r = {key: t.column(key)[0].as_py()} | K.saddle_score(x)
        ok = np.isfinite(f)
        if ok.any():
            i = int(np.nanargmax(f))
            half = np.nanmean(f) + (f[i] - np.nanmean(f)) / 2
            a = b = i
            while a > 0 and f[a - 1] >= half:
                a -= 1
            while b < len(f) - 1 and f[b + 1] >= half:
                b += 1
            r |= {"mean_ftle": np.nanmean(f), "ridge_strength": f[i], "ridge_at": i, "ridge_width": b - a + 1}
        return _table([r], [key], out)

    return path.groupBy(key).applyInArrow(run, _schema([key], out))


def sensitivity(path: DataFrame, columns: list[str], key: str = "cohort", order: str = "t") -> DataFrame:
    """Which column of a path moves the others: sensitivity and rank of each."""
    workers_import(path.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        r = K.sensitivity(np.column_stack(_ordered(t, order, *columns)))
        rank = np.argsort(np.argsort(-r["sensitivity"])) + 1 if r else []
        rows = [{key: t.column(key)[0].as_py(), "variable": c, "sensitivity": r["sensitivity"][i], "rank": rank[i], "entropy": r["entropy"]} for i, c in enumerate(columns)] if r else []
        return _table(rows, [key, "variable"], ["sensitivity", "rank", "entropy"])

    return path.groupBy(key).applyInArrow(run, _schema([key, "variable"], ["sensitivity", "rank", "entropy"]))


def influence(path: DataFrame, columns: list[str], key: str = "cohort", order: str = "t") -> DataFrame:
    """How a standardised step of one column weighs in the next step of another: a row for each ordered pair."""
    workers_import(path.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        r = K.sensitivity(np.column_stack(_ordered(t, order, *columns)))
        rows = [{key: t.column(key)[0].as_py(), "source": a, "target": b, "influence": r["influence"][i, j]} for i, a in enumerate(columns) for j, b in enumerate(columns)] if r else []
        return _table(rows, [key, "source", "target"], ["influence"])

    return path.groupBy(key).applyInArrow(run, _schema([key, "source", "target"], ["influence"]))


def sensitivity_rolling(path: DataFrame, columns: list[str], window: int = 100, stride: int = 10, key: str = "cohort", order: str = "t") -> DataFrame:
    """Sensitivities of hop windows of a path, the dominant column, and whether it is another than in the window before."""
    workers_import(path.sparkSession)
    out = ["k", "at", "entropy", *(f"sensitivity_{c}" for c in columns)]

    def run(t: pa.Table) -> pa.Table:
        x, at, rows = np.column_stack(_ordered(t, order, *columns)), _ordered(t, order, order)[0], []
        for k, end in enumerate(range(min(window, len(x)) - 1, len(x), stride)):
            if r := K.sensitivity(x[max(0, end - window + 1) : end + 1]):
                rows.append({key: t.column(key)[0].as_py(), "dominant": columns[r["dominant"]], "k": k, "at": at[end], "entropy": r["entropy"]} | {f"sensitivity_{c}": v for c, v in zip(columns, r["sensitivity"], strict=True)})
        return _table(rows, [key, "dominant"], out)

    r = path.groupBy(key).applyInArrow(run, _schema([key, "dominant"], out))
    before = F.lag("dominant").over(Window.partitionBy(key).orderBy("k"))
    return r.withColumn("transition", F.coalesce(F.col("dominant") != before, F.lit(False)))


def neighbour_pairs(path: DataFrame, columns: list[str], nearest: int = 3, key: str = "cohort") -> DataFrame:
    """Unordered pairs of paths of which one is among the `nearest` to the other, by the distance of their centres."""
    c = path.groupBy(key).agg(*(F.avg(x).alias(x) for x in columns))
    side = lambda p: c.select(F.col(key).alias(f"{key}_{p}"), *(F.col(x).alias(f"{p}_{x}") for x in columns))
    d2 = sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) * (F.col(f"a_{x}") - F.col(f"b_{x}")) for x in columns), F.lit(0.0))
    j = side("a").join(side("b"), F.col(f"{key}_a") != F.col(f"{key}_b")).withColumn("centre_distance", F.sqrt(d2))
    near = j.withColumn("__r", F.row_number().over(Window.partitionBy(f"{key}_a").orderBy("centre_distance", f"{key}_b"))).filter(F.col("__r") <= nearest)
    lo, hi = F.least(f"{key}_a", f"{key}_b"), F.greatest(f"{key}_a", f"{key}_b")
    return near.select(lo.alias("lo"), hi.alias("hi"), "centre_distance").distinct().withColumnsRenamed({"lo": f"{key}_a", "hi": f"{key}_b"})


def field_pairs(path: DataFrame, columns: list[str], nearest: int = 3, key: str = "cohort", order: str = "t") -> DataFrame:
    """Growth field on a local grid between neighbouring paths, from the points of the two: ridge, corridor, mean."""
    workers_import(path.sparkSession)
    out, ends = list(K.field_between(np.zeros(2), np.ones(2), np.zeros((0, 2)), np.zeros((0, 2)))), [f"{key}_a", f"{key}_b"]
    pairs = neighbour_pairs(path, columns, nearest, key)
    both = pairs.withColumn(key, F.explode(F.array(*ends))).join(path.select(key, F.col(order).cast("double").alias(order), *columns), key)

    def run(t: pa.Table) -> pa.Table:
        names, when = np.array(t.column(key).to_pylist(), object), t.column(order).to_numpy()
        x = np.column_stack([t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
        centres, at, after = [], [], []
        for e in ends:
            mine = np.flatnonzero(names == t.column(e)[0].as_py())
            p = x[mine[np.argsort(when[mine], kind="stable")]]
            p = p[np.isfinite(p).all(1)]
            centres.append(p.mean(0) if len(p) else np.full(len(columns), np.nan))
            at.append(p[:-1])
            after.append(p[1:])
        r = {e: t.column(e)[0].as_py() for e in ends} | {"centre_distance": t.column("centre_distance")[0].as_py()}
        return _table([r | K.field_between(*centres, np.concatenate(at), np.concatenate(after))], ends, ["centre_distance", *out])

    return both.groupBy(*ends).applyInArrow(run, _schema(ends, ["centre_distance", *out]))


def basins(path: DataFrame, columns: list[str], key: str = "cohort", order: str = "t") -> DataFrame:
    """Depth, radius and escape rate of the basin about each path's centre, from its own points."""
    workers_import(path.sparkSession)
    out = ["basin_depth", "basin_radius", "escape_rate"]

    def run(t: pa.Table) -> pa.Table:
        x = np.column_stack(_ordered(t, order, *columns))
        x = x[np.isfinite(x).all(1)]
        r = K.basin_depth(x.mean(0), x[:-1], x[1:]) if len(x) > 3 else {}
        return _table([{key: t.column(key)[0].as_py()} | r], [key], out)

    return path.groupBy(key).applyInArrow(run, _schema([key], out))


VIEWS = ["fourier_dominant_freq", "fourier_flatness", "envelope_mean", "envelope_trend", "envelope_cv", "wavelet_dominant_scale", "wavelet_entropy", "wavelet_ratio"]


def trajectory_views(path: DataFrame, columns: list[str], last: int = 32, key: str = "cohort", order: str = "t") -> DataFrame:
    """Fourier, Hilbert and wavelet views of the last `last` points of a path, for every point of it."""
    workers_import(path.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        at, x = _ordered(t, order, order)[0], np.column_stack(_ordered(t, order, *columns))
        rows = []
        for i in range(len(x)):
            w = x[max(0, i - last + 1) : i + 1]
            w = w[np.isfinite(w).all(1)]
            rows.append({key: t.column(key)[0].as_py(), "at": at[i]} | K.fourier_view(w) | K.hilbert_view(w) | K.wavelet_view(w))
        return _table(rows, [key], ["at", *VIEWS])

    return path.groupBy(key).applyInArrow(run, _schema([key], ["at", *VIEWS]))


METRICS = list(K.window_metrics(np.eye(4)))


def fingerprint_windows(obs: DataFrame, window: int = 50, stride: int = 24) -> DataFrame:
    """cohort, t, metric, value: the eighteen metrics of hop windows of a cohort's signals, cut to the shortest."""
    workers_import(obs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        wide = t.to_pandas().sort_values("signal_0").groupby("signal_id", sort=True)["value"].apply(lambda v: v[np.isfinite(v)].to_numpy())
        n = min(map(len, wide))
        x = np.stack([v[:n] for v in wide])
        rows = []
        for k, end in enumerate(range(min(window, n) - 1, n, stride)):
            m = K.window_metrics(x[:, max(0, end - window + 1) : end + 1])
            rows += [{"cohort": t.column("cohort")[0].as_py(), "metric": name, "t": k, "value": v} for name, v in m.items()]
        return _table(rows, ["cohort", "metric"], ["t", "value"])

    return obs.groupBy("cohort").applyInArrow(run, _schema(["cohort", "metric"], ["t", "value"]))


FAMILIES = ("gaussian", "clayton", "gumbel", "frank")


def copula_fits(pairs: DataFrame) -> DataFrame:
    """Best copula family of each pair by AIC, over all its samples."""
    workers_import(pairs.sparkSession)
    keys = ["cohort", "signal_a", "signal_b"]

    def run(t: pa.Table) -> pa.Table:
        x, y = _ordered(t, "t", "x", "y")
        r = K.copula_fit(x, y)
        name = FAMILIES[int(r["family"])] if np.isfinite(r["family"]) else None
        return _table([{k: t.column(k)[0].as_py() for k in keys} | r | {"family": name}], [*keys, "family"], ["kendall", "aic", "lower", "upper"])

    return pairs.groupBy(*keys).applyInArrow(run, _schema([*keys, "family"], ["kendall", "aic", "lower", "upper"]))


def smoothed(obs: DataFrame, window: int = 11, order: int = 3) -> DataFrame:
    """Observations after local polynomial smoothing along each series; on uneven axes through a resampled copy."""
    workers_import(obs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        y, c = _ordered(t, "signal_0", "value", "signal_0")
        step = np.diff(c)
        even = len(step) < 2 or np.ptp(step) < 1e-9 * max(abs(step).max(), 1e-12)
        if even:
            z = K.savgol(y, window, order)
        else:
            grid = np.linspace(c[0], c[-1], len(c))
            z = np.interp(c, grid, K.savgol(np.interp(grid, c, y), window, order))
        return _table([{"cohort": t.column("cohort")[0].as_py(), "signal_id": t.column("signal_id")[0].as_py(), "signal_0": a, "value": b} for a, b in zip(c, z, strict=True)], [*SERIES], ["signal_0", "value"])

    return obs.groupBy(*SERIES).applyInArrow(run, _schema([*SERIES], ["signal_0", "value"]))


BREAKS = ["signal_0", "magnitude", "sharpness", "pre_level", "post_level", "snr", "direction", "duration"]


def breaks(obs: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """Breaks of every series in one Arrow call each: the fast form of operators.breaks.detect, with the same columns."""
    workers_import(obs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        y, c = _ordered(t, "signal_0", "value", "signal_0")
        key = {"cohort": t.column("cohort")[0].as_py(), "signal_id": t.column("signal_id")[0].as_py()}
        y = K.filled(y)
        return _table([key | {"signal_0": c[b["r"]]} | b for b in (K.break_scan(y, sensitivity) if len(y) == len(c) else [])], [*SERIES], BREAKS)

    r = obs.groupBy(*SERIES).applyInArrow(run, _schema([*SERIES], BREAKS))
    return r.withColumn("direction", F.col("direction").cast("byte")).withColumn("duration", F.col("duration").cast("int"))
