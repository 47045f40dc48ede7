"""Operator 2: mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Every source has a weight schedule over training time 0..1, a straight line from a start to an end weight,
scaled so that its integral is the source's target in words. A source's documents follow each other in a
fixed pseudo-random order, over again while the target is not reached (at most `cap` times). The place of
a copy in that stream is a cumulative demand in words; inverting the integrated schedule turns it into a
training time, and the documents are range-sorted by it.

A source's weight is its own share at a time, not a share of all sources' tokens then: the sources' totals are
what the targets fix, and their schedules need not add up to a constant. The position reported for a document is
that of its first copy.

Running sums are taken in two levels, so that no task holds a whole source: documents fall into ranges of their
order's hash (4096, more where there are more partitions), sums run within a range, and a table of the ranges'
totals supplies what comes before. All sums are of whole numbers, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
#: Start weight as a multiple of the mean, by place in the cycle of weights; the end weight is 2 less it.
STARTS = (1.5, 1.0, 0.5)
CAP = 3


def digits(spark) -> int:
    """Hexadecimal digits that tell a source's ranges apart: at least 16 ranges for each partition."""
    return max(3, math.ceil(math.log(16 * common.parts(spark, 1), 16)))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds __m_source, __m_size in words (null text: 0), the order's hash __m_h and its range __m_cell. Rows without a
    doc_id are ordered by their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    order = F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = docs.withColumns({"__m_source": F.col("source"), "__m_id": F.col("doc_id"), "__m_size": size, "__m_h": order})
    return rows.withColumn("__m_cell", F.substring("__m_h", 1, digits(docs.sparkSession)))


OWN = ("__m_source", "__m_id", "__m_size", "__m_h", "__m_cell")


def targets(per_source: DataFrame, weights=WEIGHTS, starts=STARTS, cap: int = CAP) -> DataFrame:
    """Adds rank, weight, start, target and quota to (source, source_size).

    Sources in code point order, null last. Water filling: in order of the level at which a source's cap
    is reached, a source is capped if the level left for it and all later ones is no lower.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cyc = lambda values: F.element_at(F.array(*map(F.lit, values)), ((F.col("rank") - 1) % len(values) + 1).cast("int"))
    s = per_source.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", cyc([float(w) for w in weights])).withColumn("start", cyc([float(x) for x in starts]))
    s = s.withColumn("room", F.col("source_size").cast("double") * float(cap)).withColumn("r", F.col("room") / F.col("weight"))
    left = Window.orderBy("r", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.orderBy("r", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("r", "rank")
    s = s.withColumn("demand", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("demand") / F.sum("weight").over(left))
    s = s.withColumn("open_level", F.when(F.col("r") > F.col("level"), F.col("level")))
    s = s.withColumn("water", F.first("open_level", ignorenulls=True).over(everything))
    target = F.coalesce(F.least(F.col("room"), F.col("water") * F.col("weight")), F.col("room"))
    return s.withColumn("target", target).withColumn("quota", F.floor(target + 0.5)).select(
        "source", "source_size", "rank", "start", "target", "quota"
    )


def position(demand: Column, quota: Column, start: Column) -> Column:
    """Training time at which a source's integrated schedule reaches the demand: inverts
    x = start t + (1 - start) t^2 for x = demand / quota."""
    x = demand.cast("double") / quota.cast("double")
    return x * 2.0 / (start + F.sqrt(F.greatest(start * start + (F.lit(1.0) - start) * x * 4.0, F.lit(0.0))))


def plan(sizes: DataFrame, weights=WEIGHTS, starts=STARTS, cap: int = CAP) -> DataFrame:
    """For every (source, range): the words before it and the source's facts. Small: written once."""
    cells = sizes.groupBy("__m_source", "__m_cell").agg(F.sum("__m_size").alias("cell_size"))
    ahead = Window.partitionBy("__m_source").orderBy("__m_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = common.cut(
        cells.withColumn("__m_before", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
        .withColumn("source_size", F.sum("cell_size").over(Window.partitionBy("__m_source"))),
        "mix-cells",
    )
    per_source = cells.groupBy(F.col("__m_source").alias("source")).agg(F.max("source_size").alias("source_size"))
    t = targets(per_source, weights, starts, cap).withColumnsRenamed({"source_size": "__m_total", "target": "__m_target", "quota": "__m_quota", "start": "__m_start"})
    facts = cells.join(t, cells.__m_source.eqNullSafe(t.source)).drop("source", "rank", "source_size")
    return facts.withColumnsRenamed({"__m_source": "__f_source", "__m_cell": "__f_cell", "cell_size": "__m_cell_size"})


def placed(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds each row's facts and __m_offset, the words before it in its source's order."""
    j = rows.join(facts, (rows.__m_cell == facts.__f_cell) & rows.__m_source.eqNullSafe(facts.__f_source))
    inside = Window.partitionBy("__m_source", "__m_cell").orderBy("__m_h", "__m_id", "__m_size").rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn("__m_offset", F.col("__m_before") + F.coalesce(F.sum("__m_size").over(inside), F.lit(0)))


def mix(docs: DataFrame, weights=WEIGHTS, starts=STARTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken and position of every row.

    Null texts and texts of no word have size 0 and are never taken. An empty table gives no row. Rows that
    repeat are taken one after another. Only doc_id, source and text are read, so other columns may have any name.
    """
    rows = common.cut(sized(docs.select("doc_id", "source", "text"), seed).select(*OWN), "mix-sizes")
    p = placed(rows, plan(rows, weights, starts, cap))
    p = p.withColumn("taken", sum((copy(e) for e in range(cap)), F.lit(0).cast("long")))
    when = F.when(F.col("taken") > 0, F.round(position(F.col("__m_offset"), F.col("__m_quota"), F.col("__m_start")), 9))
    return p.select(
        F.col("__m_id").alias("doc_id"), F.col("__m_source").alias("source"), F.col("__m_size").alias("size"),
        F.col("__m_total").alias("source_size"), F.col("__m_target").alias("target"), "taken", when.alias("position"),
    )


def copy(e) -> Column:
    """Words taken from a document's e-th copy, which stands e whole rounds later in the stream."""
    left = F.col("__m_quota") - F.col("__m_total") * e - F.col("__m_offset")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("__m_size"), left))


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The mix range-sorted by the training time of each document's first copy, untaken documents last."""
    return mix(docs, **how).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def pieces(facts: DataFrame, n: int, cap: int = CAP) -> DataFrame:
    """facts with __m_e, the copy, and __m_p, a share of training time (one of n) that a range's e-th copies meet. A
    range lies in one share, or in the two or more that its copies straddle."""
    f = facts.filter("__m_cell_size > 0 and __m_quota > 0")
    f = f.withColumn("__m_e", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("__m_first", F.col("__m_before") + F.col("__m_total") * F.col("__m_e"))
    f = f.filter("__m_first < __m_quota")
    share = lambda demand: shared_by(position(demand, F.col("__m_quota"), F.col("__m_start")), n)
    last = F.least(F.col("__m_first") + F.col("__m_cell_size"), F.col("__m_quota"))
    return f.withColumn("__m_p", F.explode(F.sequence(share(F.col("__m_first")), share(last)))).drop("__m_first", "__m_cell_size")


def shared_by(at: Column, n: int) -> Column:
    return F.least(F.floor(at * n), F.lit(n - 1)).cast("int")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, starts=STARTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The mixed corpus with the documents' own columns, whatever their names: a row for each copy that words are taken
    from, whole, in order of training time from partition to partition and within each.

    Texts are shuffled once. Where a range of a source falls in training time is known from the table of ranges, so rows
    go straight to the partition of their time; there running sums inside their range give their exact place. Null
    texts and texts of no word are never taken; a null source is a source like others; rows that repeat are taken one
    after another; very long texts are taken whole; an empty table gives no row.
    """
    n = common.parts(docs.sparkSession, 1)
    sizes = common.cut(sized(docs.select("doc_id", "source", "text"), seed).select("__m_source", "__m_size", "__m_cell"), "mix-sizes")
    rows = sized(docs.select(F.struct("*").alias("__m_row"), "doc_id", "source", "text"), seed).select("__m_row", *OWN)
    f = pieces(plan(sizes, weights, starts, cap), n, cap)
    p = rows.filter("__m_size > 0").join(f, (rows.__m_cell == f.__f_cell) & rows.__m_source.eqNullSafe(f.__f_source))
    # of these numbers each goes to the partition of its place, so that partitions stand in order of time
    key = F.element_at(F.array(*map(F.lit, common.dealt_keys(n).tolist())), F.col("__m_p") + 1).cast("int")
    p = p.withColumn("__m_key", key).repartition(n, "__m_key")
    inside = Window.partitionBy("__m_key", "__m_source", "__m_cell", "__m_e").orderBy("__m_h", "__m_id", "__m_size").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("__m_offset", F.col("__m_before") + F.coalesce(F.sum("__m_size").over(inside), F.lit(0)))
    p = p.withColumn("__m_at", position(F.col("__m_offset") + F.col("__m_total") * F.col("__m_e"), F.col("__m_quota"), F.col("__m_start")))
    p = p.filter((copy(F.col("__m_e")) > 0) & (shared_by(F.col("__m_at"), n) == F.col("__m_p")))
    return p.sortWithinPartitions("__m_at", "__m_h", "__m_e").select("__m_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2_mixture over the whole documents table."""
    return curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) || ':mix') AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, list_extract(CAST([1.5, 1.0, 0.5] AS DOUBLE[]), (rank - 1) % 3 + 1) AS start,
             source_size::DOUBLE * 3.0 AS room FROM k),
r AS (SELECT *, room / weight AS r FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE
        - coalesce(sum(room) OVER (ORDER BY r, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY r, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, coalesce(least(room, (SELECT min_by(level, r) FROM l WHERE r > level) * weight), room) AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.start, floor(t.target + 0.5)::BIGINT AS quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, (greatest(0, least(size, quota - off)) + greatest(0, least(size, quota - source_size - off))
        + greatest(0, least(size, quota - 2 * source_size - off)))::BIGINT AS taken,
        CASE WHEN quota > 0 THEN off::DOUBLE / quota::DOUBLE END AS x FROM o)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(x * 2.0 / (start + sqrt(greatest(start * start + (1.0 - start) * x * 4.0, 0.0))), 9) END AS position
FROM n
"""
