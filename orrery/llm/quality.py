"""Operator 9: quality rules judged by host.

Each document is measured once and tested against rules. Failures are counted by host; a host's rate is
shrunk towards the fleet's by a beta prior fitted to all hosts (method of moments), so that a host of few
documents is not judged by them alone. The verdict on a host is joined back to its documents: in a host
whose shrunk rate reaches `bad_host`, the strict limits hold, elsewhere the usual ones. A clean document
passes either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Per cent: symbols of words, repeated lines of lines with a word, words in repeated windows of words.
USUAL = (10, 30, 20)
STRICT = (2, 10, 10)
BAD_HOST = 0.5


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = common.mix64(h)
    g = np.zeros(n, np.uint64)
    for j in range(width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    b = text.encode()
    words = b.split()  # bytes.split parts at exactly \x20 and \x09-\x0D
    lines = [x for x in b.split(b"\n") if x.strip()]
    blank = len(b) - len(b.translate(None, BLANKS))
    return (
        len(words),
        len(text) - blank,
        len(b) - len(b.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
    )


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and __q_<measure> of every row's whole text (null: no word). No shuffle."""
    common.prepare(docs.sparkSession)
    src = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))

    def run(batches):
        for batch in common.slices(batches):
            got = np.array([measure(t) for t in batch.column("__text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keep))] + [pa.array(np.ascontiguousarray(c)) for c in got.T],
                [*keep, *(f"__q_{m}" for m in MEASURES)],
            )

    schema = src.drop("__text").schema
    for m in MEASURES:
        schema = schema.add(f"__q_{m}", "long")
    return src.mapInArrow(common.tidied(run), schema)


def base_failed():
    return (F.col("__q_n_words") < 10) | (F.col("__q_n_repeat_words") * 100 > F.col("__q_n_words") * 20)


def over(limits) -> "F.Column":
    symbols, lines, repeats = limits
    return (
        (F.col("__q_n_symbols") * 100 > F.col("__q_n_words") * symbols)
        | (F.col("__q_n_dup_lines") * 100 > F.col("__q_n_lines") * lines)
        | (F.col("__q_n_repeat_words") * 100 > F.col("__q_n_words") * repeats)
    )


def host_verdicts(stats: DataFrame, host: str, bad_host: float = BAD_HOST) -> DataFrame:
    """host, n, failed, rate (shrunk), bad. A null host is a host like another.

    alpha and beta match mean and variance of the hosts' rates, the variance less what sampling explains;
    if nothing is left, the prior is as strong as the mean host's count.
    """
    by = common.cut(
        stats.groupBy(F.col(host).alias("host")).agg(
            F.count("*").alias("n"), F.sum((base_failed() | over(USUAL)).cast("long")).alias("failed")
        ),
        "host-counts",
    )
    own = F.col("failed") / F.col("n")
    m, r1, r2, inv, mean_n = by.agg(
        F.sum("failed") / F.sum("n"), F.avg(own), F.avg(own * own), F.avg(1 / F.col("n")), F.avg("n")
    ).first()
    m = m or 0.0
    spread = (r2 or 0.0) - (r1 or 0.0) ** 2 - m * (1 - m) * (inv or 0.0)
    strength = max(m * (1 - m) / spread - 1, 1e-3) if spread > 1e-9 else float(mean_n or 1.0)
    rate = (F.col("failed") + m * strength) / (F.col("n") + strength)
    return by.select("host", "n", "failed", rate.alias("rate"), (rate >= bad_host).alias("bad"))


def judged(stats: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """stats with base_failed and kept. Hosts missing from the verdicts count as good."""
    v = verdicts.select(F.col("host").alias("__host"), F.col("bad").alias("__bad"))
    j = stats.join(v, stats[host].eqNullSafe(v["__host"]), "left")
    bad = F.coalesce(F.col("__bad"), F.lit(False))
    kept = ~base_failed() & F.when(bad, ~over(STRICT)).otherwise(~over(USUAL))
    return j.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("__host", "__bad")


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row.

    Null and empty texts have no word and fail; very long ones are measured whole; repeated rows are judged
    alike; an empty table gives no row. The measures are written once, so texts are read once. Only doc_id, text and the
    host's column are read, so other columns may have any name.
    """
    stats = common.cut(measured(docs, "doc_id", host), "quality")
    out = judged(stats, host_verdicts(stats, host), host)
    names = [F.col(f"__q_{m}").alias(m) for m in MEASURES[:5]]
    return out.select("doc_id", *names, "base_failed", "kept")


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows that are kept, with their own columns, whatever their names. Texts are read twice instead of being
    shuffled. Null, empty and blank texts fail and go; a null host is a host like another; rows that repeat are judged
    alike; very long texts are measured whole; an empty table gives no row.
    """
    verdicts = common.cut(host_verdicts(common.cut(measured(docs.select(host, "text"), host), "quality"), host), "hosts")
    rows = docs.select(F.struct("*").alias("__q_row"), F.col(host).alias("__q_host"), "text")
    return judged(measured(rows, "__q_row", "__q_host"), verdicts, "__q_host").filter("kept").select("__q_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op9_host_quality over the whole documents table; a document's host is its source."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, source, text, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, text, i, array_to_string(w[i:i + 4], ' ') AS s FROM g),
m AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, text, s) > 1),
p AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM m) GROUP BY doc_id),
q AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_repeat_words > 20 * n_words AS soft,
             100 * n_symbols > 2 * n_words OR 100 * n_dup_lines > 10 * n_lines OR 100 * n_repeat_words > 10 * n_words AS strict FROM q),
b AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft)::INT)::DOUBLE AS bad FROM f GROUP BY source),
a AS (SELECT sum(bad) / sum(n) AS m, avg(bad / n * (bad / n)) - avg(bad / n) * avg(bad / n)
             - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * avg(1 / n) AS spread, avg(n) AS mean_n FROM b),
s AS (SELECT m, CASE WHEN spread > 1e-9 THEN greatest(m * (1 - m) / spread - 1, 1e-3) ELSE mean_n END AS strength FROM a),
v AS (SELECT source, (bad + m * strength) / (n + strength) >= 0.5 AS host_bad FROM b, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT CASE WHEN host_bad THEN strict ELSE soft END AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
