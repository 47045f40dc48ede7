"""The fact table (cohort, signal_id, signal_0, value) and ways to get and keep it."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = T.StructType(
    [
        T.StructField("cohort", T.StringType()),
        T.StructField("signal_id", T.StringType()),
        T.StructField("signal_0", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)
DEFAULT_COHORT = "_default"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(df: DataFrame) -> DataFrame:
    """The four columns with their types; a missing or null cohort becomes the default one."""
    cohort = F.coalesce(F.col("cohort").cast("string"), F.lit(DEFAULT_COHORT)) if "cohort" in df.columns else F.lit(DEFAULT_COHORT)
    return df.select(
        cohort.alias("cohort"), F.col("signal_id").cast("string"), F.col("signal_0").cast("double"), F.col("value").cast("double")
    )


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Parquet file or folder; sorting is left to the operators that need it."""
    return normalise(spark.read.parquet(path))


def read_sensor_text(spark: SparkSession, path: str, settings: int = 3, sensors: int = 21) -> DataFrame:
    """Space-delimited lines without header: unit, cycle, settings, sensors; ragged tails are tolerated."""
    names = ["unit", "cycle", *(f"op{i}" for i in range(1, settings + 1)), *(f"s{i}" for i in range(1, sensors + 1))]
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = [F.try_element_at(parts, F.lit(i + 1)).cast("int" if i < 2 else "double").alias(n) for i, n in enumerate(names)]
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(*cols)


def melt_sensors(wide: DataFrame) -> DataFrame:
    """Wide sensor rows to observations; the coordinate counts cycles from 0."""
    sensors = [c for c in wide.columns if c[0] == "s" and c[1:].isdigit()]
    long = wide.unpivot(["unit", "cycle"], sensors, "signal_id", "value")
    return long.select(F.col("unit").cast("string").alias("cohort"), "signal_id", (F.col("cycle") - 1).cast("double").alias("signal_0"), "value")


def obs_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cohort, signal = F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string"))
    rows = e.select(cohort.alias("cohort"), signal.alias("signal_id"), "ts", "event_id", "value")
    order = Window.partitionBy("cohort", "signal_id").orderBy("ts", "event_id")
    return rows.select("cohort", "signal_id", (F.row_number().over(order) - 1).cast("double").alias("signal_0"), "value")


def obs_events_ts(spark, sf_dir) -> DataFrame:
    """A coordinate of uneven spacing: seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("cohort"), F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("signal_id"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))") / 1e6).alias("signal_0"), "value",
    )


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_MEASURES)


def _numbered_lines(spark, sf_dir, cohort) -> DataFrame:
    """(The number is added before the measures are cast: else both the measures and their casts would be shuffled.)"""
    li = table(spark, sf_dir, "lineitem").select(cohort.alias("cohort"), *_ORDER)
    li = li.withColumn("signal_0", F.row_number().over(Window.partitionBy("cohort").orderBy(*_ORDER)) - 1)
    return li.select("cohort", F.col("signal_0").cast("double"), *(F.col(m).cast("double") for m in _MEASURES))


def obs_lineitem(spark, sf_dir) -> DataFrame:
    lines = _numbered_lines(spark, sf_dir, F.concat_ws("_", "l_returnflag", "l_linestatus"))
    return lines.unpivot(["cohort", "signal_0"], list(_MEASURES), "signal_id", "value").select("cohort", "signal_id", "signal_0", "value")


def obs_supplier(spark, sf_dir) -> DataFrame:
    """Samples with r and n as windows.indexed adds them. Suppliers are many, so lines are shuffled without their cohort, which is named behind the
    shuffle; places of samples are counted on lines, and inlining, unlike unpivot, keeps the deal: no sample is shuffled or sorted. (Parts of a given
    number are not merged by adaptive execution, so that each is sorted in memory.)"""
    cohort = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32 * spark.sparkContext.defaultParallelism)
    lines = table(spark, sf_dir, "lineitem").select(*_ORDER).repartition(parts, cohort).withColumn("cohort", cohort)
    every = Window.partitionBy("cohort")
    so_far = every.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    known = {m: F.when(F.col(m).isNotNull() & ~F.isnan(m), 1) for m in _MEASURES}
    lines = lines.withColumns({"signal_0": F.row_number().over(every.orderBy(*_ORDER)) - 1} | {f"r_{m}": F.count(known[m]).over(so_far) - 1 for m in _MEASURES})
    lines = lines.withColumns({f"n_{m}": F.count(known[m]).over(every) for m in _MEASURES})
    samples = F.array(*(F.struct(F.lit(m).alias("signal_id"), F.col(m).cast("double").alias("value"), F.col(f"r_{m}").alias("r"), F.col(f"n_{m}").alias("n")) for m in _MEASURES))
    inlined = lines.select("cohort", F.col("signal_0").cast("double"), F.inline(samples))
    return inlined.select("cohort", "signal_id", "signal_0", "value", "r", "n").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def points(spark, sf_dir) -> DataFrame:
    """label, vec_id, pos, x: embeddings in long form."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def write_output(df: DataFrame, root: str, name: str, metadata: dict[str, dict] | None = None) -> None:
    """Parquet under root/name; a table without columns is not written, one without rows keeps its schema.
    Unit metadata goes with the columns."""
    if not df.columns:
        return
    for c, m in (metadata or {}).items():
        if c in df.columns:
            df = df.withMetadata(c, m)
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_sidecar(df: DataFrame, root: str, parent: str, suffix: str) -> None:
    write_output(df, root, f"{parent}_{suffix}")


def read_output(spark: SparkSession, root: str, name: str, subdirs: tuple[str, ...] = ()) -> DataFrame | None:
    """A stage's output from its subfolder or, failing that, from the root; None if it is in neither."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for base in (*(f"{root}/{s}" for s in subdirs), root):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if path.getFileSystem(conf).exists(path):
            return spark.read.parquet(f"{base}/{name}")
    return None


def union_diagonal(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns of any."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def finite(c: str):
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(columns: list[str]):
    return functools.reduce(operator.and_, (finite(c) for c in columns))
