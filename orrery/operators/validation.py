"""Checks and clean-ups of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("signal_id", "signal_0", "value")


class InvalidObservations(ValueError):
    """Raised when required columns are missing."""


def validate(obs: DataFrame, most_null: float = 0.5, most_infinite: float = 0.0) -> DataFrame:
    """One row a check: measured, limit, passed. All numbers come from one pass."""
    missing = [c for c in REQUIRED if c not in obs.columns]
    if missing:
        raise InvalidObservations(f"missing columns: {', '.join(missing)}")
    v = F.col("value").cast("double")
    n = F.count("*")
    share = lambda c: F.coalesce(F.sum(c.cast("int")) / F.nullif(n, F.lit(0)), F.lit(0.0))
    a = obs.agg(
        n.cast("double").alias("rows"), share(v.isNull() | F.isnan(v)).alias("null"), share(F.coalesce(F.abs(v) == float("inf"), F.lit(False))).alias("infinite"),
        F.count_distinct("signal_id").cast("double").alias("signals"), share(F.col("signal_0").isNull()).alias("no_coordinate"),
    )
    checks = [("rows", 1.0, True), ("signals", 1.0, True), ("null", most_null, False), ("infinite", most_infinite, False), ("no_coordinate", 0.0, False)]
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("measured"), F.lit(limit).alias("limit"), (F.col(k) >= limit if least else F.col(k) <= limit).alias("passed")) for k, limit, least in checks))
    return a.select(F.explode(rows).alias("c")).select("c.check", "c.measured", "c.limit", "c.passed")


def constant_signals(typology: DataFrame, least_std: float = 1e-10) -> DataFrame:
    """signal_id of constant signals, by whichever column says so."""
    c = typology.columns
    if "is_constant" in c:
        flat = F.col("is_constant")
    elif "signal_std" in c:
        flat = F.coalesce(F.col("signal_std"), F.lit(0.0)) <= least_std
    else:
        name = next((x for x in ("temporal_primary", "temporal_pattern", "continuity") if x in c), None)
        flat = F.upper(F.col(name)) == "CONSTANT" if name else F.lit(False)
    return typology.filter(flat).select("signal_id").distinct()


def without_constant(obs: DataFrame, typology: DataFrame) -> DataFrame:
    return obs.join(constant_signals(typology), "signal_id", "left_anti")


def active_only(obs: DataFrame, active: DataFrame) -> DataFrame:
    return obs.join(active, "signal_id", "left_semi")


def scrub_infinite(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Infinite values become NULL in every floating column but the excepted."""
    names = [c for c, t in df.dtypes if t in ("double", "float") and c not in but]
    return df.withColumns({c: F.when(F.abs(c) != float("inf"), F.col(c)).when(F.isnan(c), F.col(c)) for c in names})


def dead_shares(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """column, dead: the share of rows where it is NULL or NaN; one pass over the table."""
    names = [c for c in df.columns if c not in keep]
    dead = lambda c: F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double"))
    a = df.agg(*(dead(c).alias(c) for c in names))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("dead")) for c in names))).alias("s")).select("s.column", "s.dead")


def prune_dead_columns(df: DataFrame, keep: tuple[str, ...], most: float = 0.9) -> DataFrame:
    """Without columns dead in more than `most` of the rows; the decision is one row of numbers."""
    dead = {r["column"] for r in dead_shares(df, keep).filter(F.col("dead") > most).collect()}
    return df.select(*(c for c in df.columns if c not in dead))


def tail(obs: DataFrame, most: int = 2000) -> DataFrame:
    """The last `most` samples of each series (a limit the series operators ask for)."""
    w = Window.partitionBy("cohort", "signal_id").orderBy(F.desc("signal_0"))
    return obs.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def ready(done: set[str], needs: dict[str, tuple[str, ...]]) -> list[str]:
    """Stages that are not done and whose needs are. needs: of each stage, the stages it reads."""
    return [s for s, before in needs.items() if s not in done and done.issuperset(before)]


def missing(stage: str, done: set[str], needs: dict[str, tuple[str, ...]]) -> list[str]:
    """What has to be made before a stage can be, in order."""
    out: list[str] = []

    def visit(s: str) -> None:
        for before in needs.get(s, ()):
            if before not in done and before not in out:
                visit(before)
                out.append(before)

    visit(stage)
    return out


def status(done: set[str], needs: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """done, ready or waiting, by stage."""
    can = set(ready(done, needs))
    return {s: "done" if s in done else "ready" if s in can else "waiting" for s in needs}
