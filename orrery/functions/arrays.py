"""Engine formulas as Catalyst expressions over a window's values (an array column) or an aggregate.

Each gives NULL where a window has too few samples or the formula has no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def null() -> Column:
    return F.lit(None).cast("double")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def moments(x: Column, m: Column, p: int) -> Column:
    power = lambda v: (v - m) * (v - m) if p == 2 else (v - m) * (v - m) * (v - m) if p == 3 else (v - m) * (v - m) * (v - m) * (v - m)
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + power(v)) / F.nullif(F.size(x), F.lit(0))


def index(x: Column) -> Column:
    return F.sequence(F.lit(0), F.size(x) - 1)


def diffs(x: Column, lag: int = 1) -> Column:
    """x[i + lag] - x[i]."""
    return F.when(F.size(x) > lag, F.zip_with(F.slice(x, lag + 1, F.size(x) - lag), F.slice(x, 1, F.size(x) - lag), lambda a, b: a - b)).otherwise(F.array().cast("array<double>"))


def bind(value: Column, f) -> Column:
    """f(value) with value taken once: as a lambda's variable it is not copied into f, as a plain column would be
    when projections are collapsed."""
    return F.get(F.transform(F.array(value), f), 0)


def median(x: Column) -> Column:
    """Of an array without nulls: sort_array, as array_sort calls a comparing lambda for every two elements."""

    def middle(s):
        half = F.floor(F.size(s) / 2).cast("int")
        return F.when(F.size(s) == 0, null()).when(F.size(s) % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)

    return bind(F.sort_array(x), middle)


def mad(x: Column, center: Column | None = None) -> Column:
    """Median distance from the median (or from center)."""
    return bind(x, lambda a: bind(median(a) if center is None else center, lambda m: median(F.transform(a, lambda v: F.abs(v - m)))))


def running(x: Column) -> Column:
    """Running sums."""
    start = F.struct(F.lit(0.0).cast("double").alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(x, start, lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["out"], F.array(a["s"] + v)).alias("out")), lambda a: a["out"])


def when_enough(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value)
