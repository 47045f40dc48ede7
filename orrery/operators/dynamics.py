"""Movement of wide signals, early-warning statistics, ridges, and stability classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from . import normalize as N


def velocity_field(obs: DataFrame, group: str = "cohort", member: str = "signal_id") -> DataFrame:
    """Speed, acceleration and its parts along and across the motion, curvature, which signal moves most and over how many
    signals the motion spreads. Signals are z-scored and stay in long form: differences are taken per signal, sums per
    (cohort, coordinate)."""
    z = N.normalise(obs, "zscore")
    w = Window.partitionBy(group, member).orderBy("signal_0")
    dt = F.lead("signal_0").over(w) - F.col("signal_0")
    dt = F.when(F.abs(dt) < 1e-12, F.lit(1e-12)).otherwise(dt)
    v = z.withColumn("v", (F.lead("scaled").over(w) - F.col("scaled")) / dt).withColumn("h", dt)
    v = v.withColumn("a", (F.col("v") - F.lag("v").over(w)) / ((F.col("h") + F.lag("h").over(w)) / 2)).filter("v is not null")
    v2, av, a2 = F.sum(F.col("v") * F.col("v")), F.sum(F.col("a") * F.col("v")), F.sum(F.col("a") * F.col("a"))
    s = v.groupBy(group, "signal_0").agg(
        v2.alias("v2"), av.alias("av"), a2.alias("a2"), F.max_by(member, F.struct(F.round(F.abs("v"), 12), F.col(member))).alias("dominant_motion_signal"), F.max(F.col("v") * F.col("v")).alias("top"),
        F.sum(F.col("v") * F.col("v") * F.when(F.col("v") != 0, F.ln(F.col("v") * F.col("v"))).otherwise(0.0)).alias("vlv"),
    )
    speed = F.sqrt("v2")
    along = F.col("av") / F.nullif(speed, F.lit(0.0))
    across = F.sqrt(F.greatest(F.col("a2") - along * along, F.lit(0.0)))
    # entropy of the shares of squared speed: ln S - (1/S) sum v^2 ln v^2
    spread = F.exp(F.ln(F.nullif(F.col("v2"), F.lit(0.0))) - F.col("vlv") / F.nullif(F.col("v2"), F.lit(0.0)))
    return s.select(
        group, "signal_0", speed.alias("speed"), F.sqrt("a2").alias("acceleration_magnitude"), along.alias("acceleration_parallel"), across.alias("acceleration_perpendicular"),
        (across / F.nullif(F.col("v2"), F.lit(0.0))).alias("curvature"), "dominant_motion_signal", (F.col("top") / F.nullif(F.col("v2"), F.lit(0.0))).alias("dominant_motion_fraction"), spread.alias("motion_dimensionality"),
    )


def ridge_proximity(field: DataFrame, speed: DataFrame, keys: tuple[str, ...] = ("cohort", "signal_id"), steep: float = 0.01) -> DataFrame:
    """Gradient and acceleration of a rolling exponent, urgency = speed x gradient, steps to zero, and a class.
    field: keys, signal_0_end, ftle. speed: cohort, signal_0_end, speed; joined on equal coordinates."""
    f = field.withColumn("gradient", W.gradient("ftle", "signal_0_end", keys))
    f = f.withColumn("ftle_acceleration", W.gradient("gradient", "signal_0_end", keys))
    j = f.join(speed.select(keys[0], "signal_0_end", "speed"), [keys[0], "signal_0_end"])
    urgency = F.col("speed") * F.col("gradient")
    steps = F.when((F.col("ftle") < 0) & (F.col("gradient") > 0), -F.col("ftle") / F.col("gradient"))
    kind = F.when(urgency > 2 * steep, "critical").when(urgency > steep, "approaching").when(urgency < -steep, "receding").otherwise("stable")
    return j.select(*keys, "signal_0_end", F.col("ftle").alias("ftle_current"), F.col("gradient").alias("ftle_gradient"), "ftle_acceleration", "speed", urgency.alias("urgency"), steps.alias("time_to_ridge"), kind.alias("urgency_class"))


def stability_class(exponent: Column) -> Column:
    return F.when(exponent < -0.1, "STRONGLY_STABLE").when(exponent < -0.01, "STABLE").when(exponent <= 0.01, "MARGINAL").when(exponent <= 0.1, "WEAKLY_UNSTABLE").when(exponent > 0.1, "CHAOTIC")


def slowing_down(obs: DataFrame, window: int = 50, stride: int = 10) -> DataFrame:
    """Rolling lag-1 autocorrelation, variance and skewness of each window, and a signal's trends in them with a score in 0..1
    (weights .3, .25, .25, .2) and a verdict."""
    rows = W.indexed(obs).withColumn("p", F.lag("value").over(W.series().orderBy("signal_0")))
    h = W.hop(rows, window, stride)
    inside = Window.partitionBy("cohort", "signal_id", "k")
    h = h.withColumn("c", F.col("value") - F.avg("value").over(inside))
    h = h.withColumn("c0", F.lag("c").over(inside.orderBy("i")))
    v2 = F.sum(F.col("c") * F.col("c"))
    per = h.groupBy("cohort", "signal_id", "k").agg(
        F.when(v2 >= 1e-10, F.sum(F.col("c") * F.col("c0")) / F.nullif(v2, F.lit(0.0))).alias("ac1"), F.var_pop("value").alias("variance"), F.when(F.stddev_pop("value") < 1e-10, 0.0).otherwise(F.skewness("value")).alias("skew")
    )
    s = per.groupBy("cohort", "signal_id").agg(
        F.count("*").alias("n_windows"), F.avg("ac1").alias("mean_ac1"), F.max_by("ac1", "k").alias("last_ac1"), F.regr_slope("ac1", "k").alias("ac1_slope"), F.regr_slope("variance", "k").alias("variance_slope"), F.avg(F.abs("skew")).alias("mean_abs_skew")
    )
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    score = 0.3 * unit(F.col("last_ac1")) + 0.25 * F.when(F.col("ac1_slope") > 0, 1.0).otherwise(0.0) + 0.25 * F.when(F.col("variance_slope") > 0, 1.0).otherwise(0.0) + 0.2 * unit(F.col("mean_abs_skew"))
    s = s.withColumn("csd_score", score)
    return s.withColumn("csd_detected", (F.col("csd_score") > 0.6) & (F.col("last_ac1") > 0.7) & (F.col("ac1_slope") > 0))


def segments(obs: DataFrame, event: float) -> DataFrame:
    """Before or after an intervention on the coordinate."""
    return obs.withColumn("segment", F.when(F.col("signal_0") < event, "pre").otherwise("post"))
