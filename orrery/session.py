"""Session defaults: ANSI and adaptive execution on, Arrow on, one BLAS thread a task."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def builder(app: str = "orrery", **conf: str) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package however the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
