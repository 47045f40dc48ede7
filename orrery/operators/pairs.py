"""Coupling of pairs of signals: histograms, ranks, lags and regressions as plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..session import workers_import

PAIR = ("cohort", "signal_a", "signal_b")


def aligned(obs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Samples of unordered pairs of a cohort's signals at equal coordinates: x, y, t. only: (cohort, signal_a, signal_b) of
    the pairs that matter, so that others are never made."""
    a = obs.select("cohort", F.col("signal_0").alias("t"), F.col("signal_id").alias("signal_a"), F.col("value").alias("x"))
    b = obs.select("cohort", F.col("signal_0").alias("t"), F.col("signal_id").alias("signal_b"), F.col("value").alias("y"))
    if only is None:
        return a.join(b, ["cohort", "t"]).filter("signal_a < signal_b").select(*PAIR, "t", "x", "y")
    return a.join(only.select(*PAIR).distinct(), ["cohort", "signal_a"]).join(b, ["cohort", "signal_b", "t"]).select(*PAIR, "t", "x", "y")


def binned(pairs: DataFrame, columns: tuple[str, ...], bins: int, shared: bool = False) -> DataFrame:
    """Adds b_<column>: equal bins over the column's range in the pair (or over both ranges)."""
    w = Window.partitionBy(*PAIR)
    for c in columns:
        lo = F.least(*(F.min(k).over(w) for k in columns)) if shared else F.min(c).over(w)
        hi = F.greatest(*(F.max(k).over(w) for k in columns)) if shared else F.max(c).over(w)
        cell = F.floor((F.col(c) - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)))
        pairs = pairs.withColumn(f"b_{c}", F.coalesce(F.least(cell, F.lit(bins - 1)), F.lit(0)))
    return pairs


def mutual_information(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Nats over a bins x bins histogram, and divided by the geometric mean of the entropies."""
    w, wx, wy = (Window.partitionBy(*PAIR, *e) for e in ((), ("b_x",), ("b_y",)))
    h = binned(pairs, ("x", "y"), bins).groupBy(*PAIR, "b_x", "b_y").agg(F.count("*").alias("m"))
    h = h.withColumns({"n": F.sum("m").over(w), "mx": F.sum("m").over(wx), "my": F.sum("m").over(wy)})
    mi = F.sum(F.col("m") / F.col("n") * F.ln(F.col("m") * F.col("n") / (F.col("mx") * F.col("my"))))
    # each cell carries its share of its row's and its column's entropy
    hx, hy = (-F.sum(F.col("m") / F.col("n") * F.ln(F.col(c) / F.col("n"))) for c in ("mx", "my"))
    s = h.groupBy(*PAIR).agg(mi.alias("mutual_info"), hx.alias("hx"), hy.alias("hy"))
    return s.select(*PAIR, "mutual_info", (F.col("mutual_info") / F.nullif(F.sqrt(F.col("hx") * F.col("hy")), F.lit(0.0))).alias("normalized_mi"))


def transfer_entropy(pairs: DataFrame, bins: int = 8) -> DataFrame:
    """Bits that one signal's past adds on the other's next value, both ways, lag 1; also over the entropy of the other's
    values."""
    b = binned(pairs, ("x", "y"), bins)
    w = Window.partitionBy(*PAIR).orderBy("t")

    def one(source: str, target: str, name: str) -> DataFrame:
        t = b.withColumn("nxt", F.lead(f"b_{target}").over(w)).filter("nxt is not null").select(*PAIR, "nxt", F.col(f"b_{target}").alias("now"), F.col(f"b_{source}").alias("src"))
        c = t.groupBy(*PAIR, "nxt", "now", "src").agg(F.count("*").alias("m"))
        part = lambda *k: F.sum("m").over(Window.partitionBy(*PAIR, *k))
        c = c.withColumns({"n": part(), "ns": part("now", "src"), "nn": part("nxt", "now"), "no": part("now"), "nx": part("nxt")})
        te = F.sum(F.col("m") / F.col("n") * F.log2(F.col("m") * F.col("no") / (F.col("ns") * F.col("nn"))))
        h = -F.sum(F.col("m") / F.col("n") * F.log2(F.col("nx") / F.col("n")))
        return c.groupBy(*PAIR).agg(te.alias(name), (te / F.nullif(h, F.lit(0.0))).alias(f"{name}_norm"))

    return one("x", "y", "te_a_to_b").join(one("y", "x", "te_b_to_a"), list(PAIR))


def divergence(pairs: DataFrame, bins: int = 10, floor: float = 1e-10) -> DataFrame:
    """Kullback-Leibler both ways and Jensen-Shannon over shared bins (nats); empty bins count as `floor`."""
    b = binned(pairs, ("x", "y"), bins, shared=True)
    n = b.groupBy(*PAIR).agg(F.count("*").alias("n"))
    long = b.select(*PAIR, F.explode(F.array(F.struct(F.lit(1).alias("p"), F.lit(0).alias("q"), F.col("b_x").alias("cell")), F.struct(F.lit(0).alias("p"), F.lit(1).alias("q"), F.col("b_y").alias("cell")))).alias("s"))
    h = long.groupBy(*PAIR, F.col("s.cell").alias("cell")).agg(F.sum("s.p").alias("p"), F.sum("s.q").alias("q")).join(n, list(PAIR))
    p, q = F.col("p") / F.col("n") + floor, F.col("q") / F.col("n") + floor
    m = (p + q) / 2
    return h.groupBy(*PAIR).agg(F.sum(p * F.ln(p / q)).alias("kl_ab"), F.sum(q * F.ln(q / p)).alias("kl_ba"), F.sum(0.5 * p * F.ln(p / m) + 0.5 * q * F.ln(q / m)).alias("js"))


def cross_correlation(pairs: DataFrame, reach: int = 50) -> DataFrame:
    """Greatest |correlation| over shifts within reach, its shift, and how alike both sides are."""
    workers_import(pairs.sparkSession)
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in PAIR), T.StructField("lag", T.IntegerType()), T.StructField("xc", T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        # shifted products of a pair's samples: no row is copied once a shift. Nulls count as samples, but add nothing
        order = np.argsort(t.column("t").to_numpy(zero_copy_only=False), kind="stable")
        z, known = [], []
        for c in ("x", "y"):
            ok = t.column(c).is_valid().to_numpy()[order]
            v = t.column(c).to_numpy(zero_copy_only=False).astype(float)[order]
            sd = v[ok].std() if ok.any() and v[ok].min() != v[ok].max() else 0.0
            known.append(ok if sd != 0 else np.zeros(len(v), bool))
            z.append(np.where(known[-1], (v - v[ok].mean()) / sd, 0.0) if sd != 0 else np.zeros(len(v)))
        n, lags, xc = len(order), [], []
        for k in range(-min(reach, n - 1), min(reach, n - 1) + 1):
            a, b = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
            lags.append(k)
            xc.append(float(z[0][a] @ z[1][b]) / n if (known[0][a] & known[1][b]).any() else None)
        return pa.table([pa.array([t.column(k)[0].as_py()] * len(lags), pa.string()) for k in PAIR] + [pa.array(lags, pa.int32()), pa.array(xc, pa.float64())], names=[*PAIR, "lag", "xc"])

    x = pairs.select(*PAIR, "t", "x", "y").groupBy(*PAIR).applyInArrow(run, schema)
    best = F.max_by(F.struct("xc", "lag"), F.struct(F.round(F.abs("xc"), 12), -F.abs("lag"), "lag"))
    s = x.groupBy(*PAIR).agg(best.alias("b"), F.sum(F.when(F.col("lag") > 0, F.abs("xc"))).alias("ahead"), F.sum(F.when(F.col("lag") < 0, F.abs("xc"))).alias("behind"))
    return s.select(*PAIR, F.col("b.xc").alias("max_xcorr"), F.col("b.lag").alias("lag_at_max"), (F.least("ahead", "behind") / F.nullif(F.greatest("ahead", "behind"), F.lit(0.0))).alias("xcorr_symmetry"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Adds u, v in (0, 1): ordinal ranks (ties by coordinate) over n + 1."""
    w = Window.partitionBy(*PAIR)
    n = F.count("*").over(w) + 1
    return pairs.withColumn("u", F.row_number().over(w.orderBy("x", "t")) / n).withColumn("v", F.row_number().over(w.orderBy("y", "t")) / n)


def rank_correlation(pairs: DataFrame) -> DataFrame:
    """Spearman, and Kendall by counting inversions of the ranks: n log n steps a pair, on all samples."""
    workers_import(pairs.sparkSession)
    r = ranked(pairs)
    s = r.groupBy(*PAIR).agg((F.covar_pop("u", "v") / F.nullif(F.stddev_pop("u") * F.stddev_pop("v"), F.lit(0.0))).alias("spearman"))
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in PAIR), T.StructField("kendall", T.DoubleType())])

    def tau(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("u").to_numpy(), kind="stable")
        place = np.argsort(np.argsort(t.column("v").to_numpy(), kind="stable"), kind="stable")[order]
        n = len(place)
        value = 1 - 4 * K.inversions(place) / (n * (n - 1)) if n > 1 else None
        return pa.table([pa.array([t.column(k)[0].as_py()], pa.string()) for k in PAIR] + [pa.array([value], pa.float64())], names=[*PAIR, "kendall"])

    return s.join(r.select(*PAIR, "u", "v").groupBy(*PAIR).applyInArrow(tau, schema), list(PAIR))


def tails(pairs: DataFrame, q: float = 0.1) -> DataFrame:
    """Empirical tail dependence of the ranks below q and above 1 - q."""
    low = (F.col("u") < q) & (F.col("v") < q)
    high = (F.col("u") > 1 - q) & (F.col("v") > 1 - q)
    return ranked(pairs).groupBy(*PAIR).agg((F.avg(low.cast("double")) / q).alias("lower_tail"), (F.avg(high.cast("double")) / q).alias("upper_tail"))


def copulas(taus: DataFrame) -> DataFrame:
    """Parameters of the usual families from Kendall's tau, and the tails they imply."""
    t = F.col("kendall")
    clayton, gumbel = F.when((t > 0) & (t < 1), 2 * t / (1 - t)), F.when((t >= 0) & (t < 1), 1 / (1 - t))
    return taus.select(*PAIR, F.sin(t * 3.141592653589793 / 2).alias("gaussian_rho"), clayton.alias("clayton_theta"), gumbel.alias("gumbel_theta"), F.pow(F.lit(2.0), -1 / clayton).alias("clayton_lower_tail"), (2 - F.pow(F.lit(2.0), 1 / gumbel)).alias("gumbel_upper_tail"))


def cointegration(pairs: DataFrame) -> DataFrame:
    """Least squares of y on x, the residual's AR(1) half-life (NULL: no decay) and its last z-score."""
    o = pairs.groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("hedge_ratio"), F.regr_intercept("y", "x").alias("intercept"))
    w = Window.partitionBy(*PAIR).orderBy("t")
    e = pairs.join(o, list(PAIR)).withColumn("e", F.col("y") - F.col("hedge_ratio") * F.col("x") - F.col("intercept")).withColumn("e0", F.lag("e").over(w))
    s = e.groupBy(*PAIR).agg(F.first("hedge_ratio").alias("hedge_ratio"), F.first("intercept").alias("intercept"), F.regr_slope("e", "e0").alias("phi"), F.stddev_samp("e").alias("sd"), F.max_by("e", "t").alias("last"))
    half = F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.ln(F.lit(2.0)) / F.ln("phi"))
    return s.select(*PAIR, "hedge_ratio", "intercept", half.alias("half_life"), (F.col("last") / F.nullif(F.col("sd"), F.lit(0.0))).alias("spread_zscore"))
