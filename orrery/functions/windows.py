"""Row-index windows: hops, frames, runs, gradients.

A sample of row index r belongs to window k (whose end is W-1+kS) with look-back L iff end-L < r <= end; solved for
k, that is a short sequence a row explodes into. Row numbers already partition the data by series, so aggregates by
(series, window) need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("cohort", "signal_id")


def series(*extra: str):
    return Window.partitionBy(*SERIES, *extra)


def indexed(obs: DataFrame, keys: tuple[str, ...] = SERIES, order: str = "signal_0") -> DataFrame:
    """Adds r (row index in the series) and n (its length). Null and NaN values do not count as samples."""
    obs = obs.filter(F.col("value").isNotNull() & ~F.isnan("value")) if "value" in obs.columns else obs
    w = Window.partitionBy(*keys)
    return obs.withColumn("r", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))


def hop(rows: DataFrame, window: int, stride: int, lookback: int | None = None, short: str = "none") -> DataFrame:
    """Explodes indexed rows into windows: adds k, window_end (row index) and i (place in the window).

    short: what a series shorter than the window gives; "none", or "one" window over all of it.
    """
    look = lookback or window
    w = F.lit(window) if short == "none" else F.least(F.lit(window), F.col("n").cast("int"))
    rows = rows.withColumn("__w", w)
    last = F.floor((F.col("n") - F.col("__w")) / stride)
    look_ = F.lit(look) if short == "none" else F.least(F.lit(look), F.col("n").cast("int"))
    kmin = F.greatest(F.lit(0), F.ceil((F.col("r") - F.col("__w") + 1) / stride))
    kmax = F.least(last, F.floor((F.col("r") - F.col("__w") + look_) / stride))
    rows = rows.withColumn("__a", kmin.cast("int")).withColumn("__b", kmax.cast("int")).filter("n >= __w and __a <= __b")
    rows = rows.withColumn("k", F.explode(F.sequence("__a", "__b")))
    end = F.col("__w") - 1 + F.col("k") * stride
    start = F.greatest(end - look_ + 1, F.lit(0))
    return rows.withColumn("window_end", end).withColumn("i", F.col("r") - start).drop("__a", "__b", "__w")


def window_arrays(rows: DataFrame, keys: tuple[str, ...] = (*SERIES, "k"), value: str = "value") -> DataFrame:
    """One row a window: x (values in order), n_obs and the coordinates of its ends."""
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", value))), lambda s: s[value]).alias("x"),
        F.count("*").alias("n_obs"),
        F.min("signal_0").alias("signal_0_start"),
        F.max("signal_0").alias("signal_0_end"),
    ).withColumn("signal_0_center", (F.col("signal_0_start") + F.col("signal_0_end")) / 2)


def rolling(window: int, keys: tuple[str, ...] = SERIES, order: str = "signal_0"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)


def runs(df: DataFrame, flag: Column, keys: tuple[str, ...], order: str) -> DataFrame:
    """Adds run: a number that is constant over consecutive rows of equal flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(flag.eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w)).drop("__c")


def gradient(y: str, x: str, keys: tuple[str, ...]) -> Column:
    """Second-order differences on an uneven axis; one-sided at the ends. Steps below 1e-12 count as that."""
    w = Window.partitionBy(*keys).orderBy(x)
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    a, b = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    a, b = (F.when(F.abs(h) < 1e-12, F.lit(1e-12)).otherwise(h) for h in (a, b))
    middle = (a * a * y2 - b * b * y0 + (b * b - a * a) * y1) / (a * b * (a + b))
    return F.when(y0.isNull() & y2.isNull(), F.lit(None).cast("double")).when(y0.isNull(), (y2 - y1) / b).when(y2.isNull(), (y1 - y0) / a).otherwise(middle)


def fill_linear(df: DataFrame, value: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """Null and NaN values linearly interpolated in row index; ends take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(F.col(value))
    df = df.withColumn("__v", v).withColumn("__r", F.row_number().over(w))
    at = F.when(F.col("__v").isNotNull(), F.col("__r"))
    # what follows is taken from the end backwards: a frame up to the end would be gone through again for every row
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("__r"), F.col("__r").desc()))
    df = df.withColumn("__v0", F.last("__v", True).over(back)).withColumn("__r0", F.last(at, True).over(back))
    df = df.withColumn("__v1", F.last("__v", True).over(ahead)).withColumn("__r1", F.last(at, True).over(ahead))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__r") - F.col("__r0")) / F.nullif(F.col("__r1") - F.col("__r0"), F.lit(0))
    return df.withColumn(value, F.coalesce("__v", line, "__v0", "__v1")).drop("__v", "__r", "__v0", "__r0", "__v1", "__r1")
