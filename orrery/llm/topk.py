"""Operator 1: exact top-k inner product search over vectors grouped by length.

Vectors are cut into buckets of similar length. For a query q with a known lower bound t of its k-th best product,
a vector p can only matter if cos(q, p) >= t / (|q| |p|); in a bucket of greatest length l that is the local
threshold t / (|q| l). Above 1 the bucket is skipped; a high threshold makes single coordinates selective, so the
bucket is pruned by coordinates (a unit vector that close to q has each coordinate in a narrow interval around q's);
under a low one, only by length. What is left is verified by whole-number products.

The first bounds come from the longest vectors. Queries meet buckets in blocks: a bucket's vectors travel only to the
blocks in which some query can still reach the bucket, each such pair is one group, and each group reports at most k
rows a query. Buckets and blocks grow with the table up to a size that a task holds easily (16 MB of 64 numbers).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Least and greatest rows of a bucket and of a block of queries; vectors compared at a time; vectors for first bounds.
BUCKET_ROWS, QUERY_ROWS, INNER_ROWS, SEEDS = (8192, 32768), (4096, 16384), 512, 1024
#: From this local cosine threshold on, coordinates prune better than lengths alone.
COORDINATES_FROM, FOCUS = 0.6, 4


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor(scale x) as int64s, packed), n2 (squared length). Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part."""
    common.prepare(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            ids, out, n2 = [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                f = np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if not np.isfinite(f).all():
                    continue
                ids.append(i)
                out.append(f.astype("<i8").tobytes())
                n2.append(float((f * f).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(n2, pa.float64())], ["vec_id", "v", "n2"])

    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return src.mapInArrow(common.tidied(run), "vec_id long, v binary, n2 double")


def matrix(column, width: int) -> np.ndarray:
    """Rows padded with zeros to the width; exact in float64 unless the products are too large."""
    out = np.zeros((len(column), width), np.int64)
    for k, x in enumerate(column):
        v = np.frombuffer(x.as_buffer(), "<i8")
        out[k, : len(v)] = v
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as int64 (wrapping beyond)."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2.0**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int, bound: np.ndarray):
        self.k, self.bound = k, bound.astype(np.float64)
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.n = queries

    def add(self, row, score, ids) -> None:
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = common.runs(row)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.bound[row[last]] = np.maximum(self.bound[row[last]], score[last])
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]


def search_bucket(best: Best, q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray) -> dict:
    """One bucket against a block of queries; counts what each way of pruning left."""
    q_len, p_len = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((p.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-p_len, kind="stable")
    used = {"skipped": 0, "length": 0, "coordinate": 0}
    unit_q = q / np.where(q_len > 0, q_len, 1)[:, None]
    for a in range(0, len(order), INNER_ROWS):
        some = order[a : a + INNER_ROWS]
        length, rows, ids = p_len[some], p[some], p_ids[some]
        reach = q_len * length[0]
        local = np.where(reach > 0, best.bound / np.where(reach > 0, reach, 1), np.where(best.bound > 0, np.inf, -1.0))
        live = np.flatnonzero(local <= 1 + 1e-9)
        used["skipped"] += len(q) - len(live)
        fine = live[local[live] >= COORDINATES_FROM]
        wide = live[local[live] < COORDINATES_FROM]
        if len(wide):
            # by length: the vectors are in order of it, so each query needs a prefix
            need = np.where(q_len[wide] > 0, best.bound[wide] / np.where(q_len[wide] > 0, q_len[wide], 1), -1.0)
            n = int(np.searchsorted(-length, -(need.min() * (1 - 1e-9)), "right"))
            s = exact(q[wide], rows[:n])
            r, c = np.nonzero(s >= best.bound[wide, None])
            own = q_ids[wide[r]] == ids[c]
            r, c = r[~own], c[~own]
            best.add(wide[r], s[r, c], ids[c])
            used["length"] += n * len(wide)
        if len(fine):
            unit_p = rows / np.where(length > 0, length, 1)[:, None]
            hits: list = []
            for j in fine.tolist():
                t = min(local[j], 1.0) - 1e-9
                focus = np.argsort(-np.abs(unit_q[j]))[:FOCUS]
                x = unit_q[j, focus]
                slack = np.sqrt(np.maximum((1 - x * x) * (1 - t * t), 0)) + 1e-9
                # angles to an axis end at 0 and 180 degrees: there a limit is 1 or -1
                ok = ((unit_p[:, focus] >= x * t - slack) | (x <= -t)) & ((unit_p[:, focus] <= x * t + slack) | (x >= t)) if t > 0 else np.ones((len(rows), 1), bool)
                c = np.flatnonzero(ok.all(1))
                used["coordinate"] += len(c)
                if len(c):
                    s = exact(q[j : j + 1], rows[c])[0]
                    keep = (s >= best.bound[j]) & (ids[c] != q_ids[j])
                    hits.append((np.full(int(keep.sum()), j), s[keep], ids[c][keep]))
            if hits:
                best.add(*(np.concatenate(x) for x in zip(*hits, strict=True)))
    return used


def pieces_of(rows: int, sizes: tuple[int, int], spread: int) -> int:
    """How many pieces: of the least size until there are `spread` of them, then larger, then of the greatest size."""
    least, greatest = sizes
    return max(1, min(math.ceil(rows / least), spread), math.ceil(rows / greatest))


def meetings(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """The candidates (bucket, ...) once for each block that asks for their bucket; asked: block, buckets."""
    pairs = asked.select(F.col("block").alias("to"), F.explode("buckets").alias("bucket")).distinct()
    return candidates.join(pairs, "bucket").withColumnRenamed("to", "block")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query with all other vectors.

    Queries are the rows whose vec_id is divisible by `every`. Components beyond a shorter vector's end count as 0.
    Rows that repeat a vec_id are vectors like others, but none of them answers a query of that id; a query row that
    repeats exactly is asked once. An empty table, or one vector alone, gives no row. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    table = common.cut(quantized(vectors, scale), "vectors")
    n, width = table.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = (width or 0) // 8
    spread = common.parts(spark)
    want = pieces_of(n, BUCKET_ROWS, spread)
    most = math.ceil(n / want)
    cuts = sorted(set(table.approxQuantile("n2", [i / want for i in range(1, want)], 0.1 / want))) if want > 1 else []
    step = F.lit(0)
    for half in _search_tree(cuts):
        step = half
    bucket = step.cast("int")
    placed = table.withColumn("range", bucket)
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"), F.max("n2").alias("top")).collect()  # one row for each bucket
    split = {r.range: max(1, math.ceil(r.n / most)) for r in sizes}
    reach = [(r.range, s, math.sqrt(r.top)) for r in sizes for s in range(split[r.range])]
    number = {(r, s): i for i, (r, s, _) in enumerate(reach)}
    longest = np.array([x[2] for x in reach])
    seeds = table.orderBy(F.desc("n2"), "vec_id").limit(SEEDS).collect()
    seed_ids = np.array([r.vec_id for r in seeds])
    seed_rows = np.zeros((len(seeds), width), np.int64)
    for i, r in enumerate(seeds):
        seed_rows[i, : len(r.v) // 8] = np.frombuffer(bytes(r.v), "<i8")
    queries = table.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    blocks = pieces_of(queries.count(), QUERY_ROWS, max(1, spread // want))

    def bound(batches):
        for batch in common.slices(batches, 4 << 20, 1024):
            q, ids = matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            s = exact(q, seed_rows).astype(np.float64)
            s[ids[:, None] == seed_ids[None, :]] = -np.inf
            t = -np.sort(-s, 1)[:, k - 1] if s.shape[1] >= k else np.full(len(ids), -np.inf)
            length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            where = [np.flatnonzero(length[i] * longest * (1 + 1e-9) >= t[i]).astype(np.int32) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(t), pa.array(where, pa.list_(pa.int32()))], ["vec_id", "v", "bound", "buckets"])

    asked = queries.select("vec_id", "v").mapInArrow(common.tidied(bound), "vec_id long, v binary, bound double, buckets array<int>")
    asked = common.cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), "top-queries")

    def home(batches):
        for batch in batches:
            r, i = batch.column("range").to_numpy(), batch.column("vec_id").to_numpy()
            salt = (common.mix64(i.view(np.uint64)) % np.array([split[x] for x in r.tolist()], np.uint64)).astype(np.int64)
            b = np.array([number[x] for x in zip(r.tolist(), salt.tolist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(b, pa.int32())], ["vec_id", "v", "bucket"])

    candidates = placed.select("vec_id", "v", "range").mapInArrow(common.tidied(home), "vec_id long, v binary, bucket int")
    candidates = meetings(candidates, asked)
    asked = asked.select("vec_id", "v", "bound", "block", F.explode("buckets").alias("bucket"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        p, p_ids = matrix(left.column("v").combine_chunks(), width), left.column("vec_id").to_numpy()
        q, q_ids = matrix(right.column("v").combine_chunks(), width), right.column("vec_id").to_numpy()
        best = Best(len(q), k, right.column("bound").to_numpy())
        if len(p) and len(q):
            search_bucket(best, q, q_ids, p, p_ids)
        v = right.column("v").take(pa.array(best.row))
        return pa.table({"query_id": pa.array(q_ids[best.row], pa.int64()), "v": v, "vec_id": pa.array(best.id, pa.int64()), "score": pa.array(best.score, pa.int64())})

    key = ["bucket", "block"]
    found = candidates.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "query_id long, v binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_tree(cuts: list[float]):
    """A column for the number of cuts not above n2, as a binary search by nested conditions."""

    def tree(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("n2") >= cuts[m], tree(m + 1, b)).otherwise(tree(a, m))

    yield tree(0, len(cuts))


def query(spark, sf_dir: str) -> DataFrame:
    """op1_topk over the whole embeddings table."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""
