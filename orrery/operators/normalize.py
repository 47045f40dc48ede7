"""Per-signal summaries, departures and normalisation."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("cohort", "signal_id")
MAD_SCALE, SMALL = 1.4826, 1e-10


class Method(str, Enum):
    ZSCORE = "zscore"
    ROBUST = "robust"
    MAD = "mad"
    MINMAX = "minmax"
    NONE = "none"


def quantile(c, p: float) -> Column:
    return F.percentile(c, F.lit(p))


def statistics(obs: DataFrame) -> DataFrame:
    """One pass: count, moments, range and quartiles of each signal."""
    v = F.col("value")
    return obs.groupBy(*SERIES).agg(
        F.count("value").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        quantile(v, 0.5).alias("median"), quantile(v, 0.25).alias("q1"), quantile(v, 0.75).alias("q3"), F.var_samp(v).alias("variance"),
    ).select("*", (F.col("max") - F.col("min")).alias("range"), (F.col("q3") - F.col("q1")).alias("iqr"), F.when(F.abs("mean") > SMALL, F.col("std") / F.abs("mean")).alias("cv"))


def params(obs: DataFrame, method: Method | str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """center and scale of each signal; a scale under 1e-10 becomes 1."""
    v, method = F.col("value"), Method(method)
    if method is Method.MAD:
        med = obs.groupBy(*keys).agg(quantile(v, 0.5).alias("center"))
        dev = obs.join(med, list(keys)).groupBy(*keys).agg(F.first("center").alias("center"), (quantile(F.abs(v - F.col("center")), 0.5) * MAD_SCALE).alias("scale"))
        out = dev
    else:
        center, scale = {
            Method.ZSCORE: (F.avg(v), F.stddev_pop(v)),
            Method.ROBUST: (quantile(v, 0.5), quantile(v, 0.75) - quantile(v, 0.25)),
            Method.MINMAX: (F.min(v), F.max(v) - F.min(v)),
            Method.NONE: (F.lit(0.0), F.lit(1.0)),
        }[method]
        out = obs.groupBy(*keys).agg(center.alias("center"), scale.alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") < SMALL, 1.0).otherwise(F.col("scale")))


def normalise(obs: DataFrame, method: Method | str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds center, scale and scaled = (value - center) / scale."""
    return obs.join(params(obs, method, keys), list(keys)).withColumn("scaled", (F.col("value") - F.col("center")) / F.col("scale"))


def denormalise(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("value", F.col("scaled") * F.col("scale") + F.col("center"))


def zscores(obs: DataFrame, limit: float = 3.0) -> DataFrame:
    """z against the signal's sample deviation (0 for a flat signal) and whether it departs."""
    w = Window.partitionBy(*SERIES)
    c = obs.withColumn("m", F.avg("value").over(w)).withColumn("s", F.stddev_samp("value").over(w))
    z = F.when(F.col("s") > SMALL, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    return c.select(*obs.columns, z.alias("zscore"), (F.abs(z) > limit).alias("is_departure"))


def mad_departures(obs: DataFrame) -> DataFrame:
    """Modified z-score 0.6745 (x - median) / MAD, departure and severity."""
    w = Window.partitionBy(*SERIES)
    c = obs.withColumn("med", quantile("value", 0.5).over(w)).withColumn("dev", F.abs(F.col("value") - F.col("med"))).withColumn("mad", quantile("dev", 0.5).over(w))
    flat = F.col("mad") <= SMALL
    z = F.when(flat, 0.0).otherwise(0.6745 * (F.col("value") - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0)))
    a = F.abs(z)
    severity = F.when(flat, "CONSTANT").when(a > 5, "EXTREME").when(a > 3.5, "HIGH").when(a > 2.5, "MODERATE").when(a > 2, "MILD").otherwise("NORMAL")
    return c.select(*obs.columns, z.alias("mad_score"), (a > 3.5).alias("is_departure"), severity.alias("severity"))


def rolling_mad(obs: DataFrame, reach: int = 50) -> DataFrame:
    """Median of the rows around each, and the departure from it in units of the frame's MAD."""
    w = Window.partitionBy(*SERIES).orderBy("signal_0").rowsBetween(-reach, reach)
    c = obs.withColumn("med", quantile("value", 0.5).over(w)).withColumn("frame", F.collect_list("value").over(w))
    dev = F.array_sort(F.transform("frame", lambda v: F.abs(v - F.col("med"))))
    n = F.size("frame")
    half = F.floor(n / 2).cast("int")
    mad = F.when(n % 2 == 1, F.get(dev, half)).otherwise((F.get(dev, half - 1) + F.get(dev, half)) / 2)
    c = c.withColumn("mad", mad)
    return c.select(*obs.columns, F.col("med").alias("rolling_median"), F.col("mad").alias("rolling_mad"), F.when(F.col("mad") > SMALL, 0.6745 * (F.col("value") - F.col("med")) / F.col("mad")).otherwise(0.0).alias("rolling_score"))


def recommend(obs: DataFrame) -> DataFrame:
    """A method for each cohort: many outliers or very heavy tails mad, heavy tails or skew robust, else zscore."""
    w = Window.partitionBy(*SERIES)
    q1, q3 = quantile("value", 0.25).over(w), quantile("value", 0.75).over(w)
    c = obs.withColumn("q1", q1).withColumn("q3", q3)
    iqr = F.col("q3") - F.col("q1")
    out = ((F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)).cast("int")
    per = c.groupBy(*SERIES).agg(F.kurtosis("value").alias("kurt"), F.skewness("value").alias("skew"), F.avg(out).alias("outliers"))
    g = per.groupBy("cohort").agg(F.avg("outliers").alias("outlier_rate"), F.avg("kurt").alias("mean_kurtosis"), F.avg(F.abs("skew")).alias("mean_abs_skew"))
    pick = F.when((F.col("outlier_rate") > 0.05) | (F.col("mean_kurtosis") > 10), "mad").when((F.col("mean_kurtosis") > 3) | (F.col("mean_abs_skew") > 1), "robust").otherwise("zscore")
    return g.withColumn("method", pick)


def pair_correlation(obs: DataFrame, least: int = 10) -> DataFrame:
    """Pearson of every pair of signals of a cohort over shared coordinates; one self-join, NULL for a flat signal."""
    a = obs.select("cohort", "signal_0", F.col("signal_id").alias("signal_a"), F.col("value").alias("x"))
    b = obs.select("cohort", "signal_0", F.col("signal_id").alias("signal_b"), F.col("value").alias("y"))
    j = a.join(b, ["cohort", "signal_0"]).filter("signal_a < signal_b")
    r = F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    return j.groupBy("cohort", "signal_a", "signal_b").agg(F.count("*").alias("n"), r.alias("correlation")).filter(F.col("n") >= least)


def fingerprint(features: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean and deviation of each feature over a signal's windows, some correlations, and volatility (mean deviation).

    Features the frame lacks count as NULL; which they are is known when the plan is built.
    """
    have = set(features.columns)
    f = features.withColumns({n: F.lit(None).cast("double") for n in names if n not in have})
    # over the windows that have both
    sd = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    r = lambda x, y: F.covar_pop(x, y) / F.nullif(sd(x, y) * sd(y, x), F.lit(0.0))
    aggs = [F.count("*").alias("n_windows"), *(F.avg(n).alias(f"mean_{n}") for n in names), *(F.stddev_samp(n).alias(f"std_{n}") for n in names), *(r(x, y).alias(f"corr_{x}_{y}") for x, y in pairs)]
    out = f.groupBy(*SERIES).agg(*aggs)
    volatility = sum((F.coalesce(f"std_{n}", F.lit(0.0)) for n in names), F.lit(0.0)) / len(names)
    return out.withColumn("volatility", volatility)


def similarity(prints: DataFrame, names: list[str]) -> DataFrame:
    """Bhattacharyya distance of every pair of a cohort's fingerprints, over the features that vary in both."""
    a, b = prints.alias("a"), prints.alias("b")
    j = a.join(b, (F.col("a.cohort") == F.col("b.cohort")) & (F.col("a.signal_id") < F.col("b.signal_id")))
    parts = []
    for n in names:
        ma, mb, sa, sb = (F.col(f"{t}.{k}_{n}") for k in ("mean", "std") for t in "ab")
        both = sa * sa + sb * sb
        parts.append(F.when((sa > SMALL) & (sb > SMALL), 0.25 * (ma - mb) * (ma - mb) / both + 0.5 * F.ln(both / (2.0 * sa * sb))))
    d = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return j.select(
        F.col("a.cohort").alias("cohort"), F.col("a.signal_id").alias("signal_a"), F.col("b.signal_id").alias("signal_b"), d.alias("distance"), n.alias("n_features"),
        (d / F.nullif(n, F.lit(0))).alias("normalized_distance"), F.exp(-d).alias("similarity"), F.abs(F.col("a.volatility") - F.col("b.volatility")).alias("volatility_diff"),
    )
