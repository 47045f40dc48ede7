"""Operator 5: n-gram Jaccard join by chosen paths.

Every text is the set of its five-word strings. Equal sets are one node. A run splits all nodes on a sampled
coordinate of their minimum hashes, so those that share the token meet; a bucket that is still large is split
again on further sampled tokens, with branching so that similar sets keep a common path, and small buckets are
compared by brute force on sketches. Runs are repeated until a pair at the threshold is missed with probability
below 1 - recall. Links found that way only propose: proposed groups are then compared exactly on their sets.

What comes back is linear: buckets and groups report one row a member (its links, and the least member of its part),
never pairs; components are found by star contraction. Links are counted exactly, so all members of a proposed group
are compared: one of more than `block` members is dealt out as pairs of blocks, for which each member's set travels
once for every `block` members of its group.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

COORDINATES, HOT_LEVELS = 64, 3


def least_agreeing(similarity: float) -> int:
    """Four standard deviations of the sketch's estimate below the threshold."""
    return math.floor(COORDINATES * similarity - 4 * math.sqrt(COORDINATES * similarity * (1 - similarity)))


def runs_needed(similarity: float, recall: float, deepest: int = 8) -> int:
    """How many runs miss a pair at the threshold that passes the sketch filter with probability 1 - recall at most.

    Runs share the pair's sketches, so the m coordinates it agrees in are drawn once: then a run keeps it if its root
    coordinate (each run has another) is among them, and at each of `deepest` further levels with 1 - (1 - m / 64)^2.
    """
    c, cases = COORDINATES, []
    for m in range(max(least_agreeing(similarity), 1), c + 1):
        chance = math.comb(c, m) * similarity**m * (1 - similarity) ** (c - m)
        cases.append((m, chance, 1 - (1 - (1 - m / c) ** 2) ** deepest))

    def missed(runs: int) -> float:
        full, rest = divmod(runs, c)
        ways = math.comb(c, rest)
        return sum(
            chance * sum(math.comb(m, a) * math.comb(c - m, rest - a) / ways * lost ** (full * m + a) for a in range(min(m, rest) + 1))
            for m, chance, lost in cases
        )

    return next(r for r in itertools.count(1) if missed(r) <= 1 - recall)


def deepest_level(limit: int, small: int) -> int:
    """Levels of splitting below a root: those of large buckets, and halvings to `small` of one that is dealt out in
    blocks, which may come to somewhat more than the limit."""
    return HOT_LEVELS + max(0, math.ceil(math.log2(limit / small))) + 1


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word strings; a text of fewer words is one string; of none, none."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    g = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    return np.unique(common.mix64(g))


def multipliers() -> np.ndarray:
    return common.mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes, a row for each non-empty set."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for i, m in enumerate(multipliers()):
        out[:, i] = np.minimum.reduceat(flat * m, at)
    return out


def sketched(docs: DataFrame, runs: int, n: int) -> DataFrame:
    """doc_id, th (hash of the text), sig (128 bits of the set), keys (its bucket in each run), sketch (16 bits a
    coordinate)."""
    common.prepare(docs.sparkSession)
    salts = common.mix64(np.arange(runs, dtype=np.uint64) + np.uint64(77))

    def run(batches):
        for batch in common.slices(batches, 3 << 20):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            sig = [common_sig(s) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sketch = [None] * len(sets), [None] * len(sets)
            if full:
                least = sketches([sets[i] for i in full])
                bucket = common.mix64(least[:, np.arange(runs) * 7 % COORDINATES] ^ salts).view(np.int64)
                low = (common.mix64(least) >> np.uint64(48)).astype("<u2")
                for k, i in enumerate(full):
                    keys[i], sketch[i] = bucket[k], low[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "th", "sig", "keys", "sketch"],
            )

    return identified(docs).mapInArrow(common.tidied(run), "doc_id long, th long, sig binary, keys array<long>, sketch binary")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and th: rows that repeat a doc_id are told apart by their text's hash."""
    return common.texts(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def common_sig(s: np.ndarray) -> bytes | None:
    """128 bits that equal sets share; None for the empty set."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def split_hot(rows: DataFrame, limit: int, depth: int = HOT_LEVELS) -> DataFrame:
    """Buckets over the limit are split on two further sampled tokens, up to `depth` times; one that still is
    over it is a mass of similar sets and is dealt out as pairs of blocks. Nothing is dropped."""
    done = None
    for level in range(depth + 1):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        hot = common.cut(sizes.select(F.col("bucket").alias("hot"), "n"), "hot-buckets")
        if hot.isEmpty():
            break
        j = rows.join(hot, rows.bucket == hot.hot, "left")
        calm = j.filter("hot is null").select("bucket", "node", "sketch")
        done = calm if done is None else done.unionAll(calm)
        j = j.filter("hot is not null")
        if level < depth:
            child = []
            for k in range(2):
                at = F.pmod(F.xxhash64("bucket", F.lit(k), F.lit(level)), F.lit(COORDINATES)).cast("int")
                token = F.col("sketch").substr(at * 2 + 1, F.lit(2))
                child.append(F.xxhash64("bucket", at, token))
            rows = j.select(F.explode(F.array_distinct(F.array(*child))).alias("bucket"), "node", "sketch")
            rows = common.cut(rows, "split-buckets")
        else:
            blocks = F.ceil(F.col("n") / (limit // 2)).cast("int")
            mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
            j = j.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            pair = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
            return done.unionAll(j.select(pair.alias("bucket"), "node", "sketch"))
    return rows if done is None else done.unionAll(rows)


def grouped(batches, key: str, most: int = 1 << 20):
    """Runs of equal keys in sorted batches, whole though they may span batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        first = common.runs(k)
        for a, b in common.pieces(first, len(k)):
            if held and held[0][1] != k[a]:
                yield [x for x, _ in held]
                held = []
            held.append((batch.slice(a, b - a), k[a]))
    if held:
        yield [x for x, _ in held]


def parts_of(near: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ids a (rows) and b (columns; None: the same ids) the least id of its connected part."""
    same = b is None
    b = a if same else b
    root_a, root_b = np.full(len(a), -1, np.int64), np.full(len(b), -1, np.int64)
    open_a, open_b = np.ones(len(a), bool), np.ones(len(b), bool)
    if same:
        open_b, root_b = open_a, root_a
    ids = a if same else np.concatenate([a, b])
    for i in np.argsort(ids, kind="stable").tolist():
        left = i < len(a)
        if not (open_a[i] if left else open_b[i - len(a)]):
            continue
        front = np.array([i if left else i - len(a)])
        while len(front):
            (open_a if left else open_b)[front] = False
            (root_a if left else root_b)[front] = ids[i]
            reached = near[front].any(0) if left else near[:, front].any(1)
            front = np.flatnonzero(reached & (open_b if left else open_a))
            left = same or not left
    return root_a, root_b


def alike(sketch: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree in at least `least` coordinates."""
    n = len(sketch)
    out = np.zeros((n, n), bool)
    step = max(1, (4 << 20) // (n * sketch.shape[1]))
    for a in range(0, n, step):
        out[a : a + step] = (sketch[a : a + step, None, :] == sketch[None, :, :]).sum(-1, dtype=np.uint8) >= least
    return out


def proposals(ids: np.ndarray, sketch: np.ndarray, least: int, small: int, bucket: int, path: tuple = ()):
    """(ids, roots) of proposed parts of one bucket: recursion on two sampled tokens, brute force when small.

    The sampling follows the bucket's key, so runs split on tokens of their own."""
    n = len(ids)
    if n < 2:
        return
    if n > small:
        rng = np.random.default_rng((bucket & (2**64 - 1), *path))
        pick = rng.choice(sketch.shape[1], 2, replace=False)
        children = []
        for c in pick:
            order = np.argsort(sketch[:, c], kind="stable")
            children += [order[a:b] for a, b in common.pieces(common.runs(sketch[order, c]), n) if b - a > 1]
        if not children or max(map(len, children)) <= n // 2:
            for k, child in enumerate(children):
                yield from proposals(ids[child], sketch[child], least, small, bucket, (*path, k))
            return
    root = parts_of(alike(sketch, least), ids)[0]
    apart = root != ids
    if apart.any():
        yield ids[apart], root[apart]


def proposed_links(rows: DataFrame, least: int, small: int) -> DataFrame:
    """u, v: each proposed member and the least member of its part in some bucket."""

    def run(batches):
        us, vs = [], []
        for group in grouped(batches, "bucket"):
            n = sum(b.num_rows for b in group)
            if n < 2:
                continue
            ids = np.concatenate([b.column("node").to_numpy() for b in group])
            raw = b"".join(x.as_py() for b in group for x in b.column("sketch"))
            sketch = np.frombuffer(raw, "<u2").reshape(n, COORDINATES)
            for u, v in proposals(ids, sketch, least, small, int(group[0].column("bucket")[0].as_py())):
                us.append(u)
                vs.append(v)
            if len(us) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    n = common.parts(rows.sparkSession, 1)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(common.tidied(run), "u long, v long")


def overlaps(one: list[np.ndarray], other: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each of one with each of the other sets (None: the same), by blocks of the shared
    elements' incidence matrices; whole numbers, exact in float32 up to 2^24."""
    sets = one if other is None else [*one, *other]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = common.runs(flat)
    size = np.diff(np.append(first, len(flat)))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)
    row, column = row[shared], column[shared]
    out = np.zeros((len(one), len(one if other is None else other)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int((size > 1).sum()) + width, width))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        if a < b:
            m = np.zeros((len(sets), width), np.float32)
            m[row[a:b], column[a:b] - k * width] = 1
            out += m[: len(one)] @ (m if other is None else m[len(one) :]).T
    return out


def verified(groups: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """node, root, links from exact comparison within each group: of all its rows, or of one block's with the other's."""

    def run(batches):
        rows = {"node": [], "root": [], "links": []}
        held = 0
        for group in grouped(batches, "g"):
            col = lambda name: np.concatenate([b.column(name).to_numpy() for b in group])  # noqa: E731,B023
            # a node's row may repeat in docs
            ids, first = np.unique(col("node"), return_index=True)
            if len(ids) < 2:
                continue
            copies, mine = col("copies")[first], col("mine")[first]
            cross = bool(group[0].column("cross")[0].as_py())
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for b in group for x in b.column("set")]
            sets = [sets[i] for i in first.tolist()]
            size = np.array([len(s) for s in sets], np.float64)
            left = mine == mine.min() if cross else np.ones(len(ids), bool)
            a, b = np.flatnonzero(left), np.flatnonzero(~left) if cross else None
            both = overlaps([sets[i] for i in a.tolist()], None if b is None else [sets[i] for i in b.tolist()])
            near = np.empty(both.shape, bool)
            for k in range(0, len(a), 512):  # the tests in float64, some rows at a time
                x, y = both[k : k + 512].astype(np.float64), size[a[k : k + 512], None] + size[None, a if b is None else b]
                near[k : k + 512] = x * denominator >= (y - x) * numerator
            if b is None:
                np.fill_diagonal(near, False)
                root, links = parts_of(near, ids)[0], near @ copies
            else:
                root, links = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
                root[a], root[b] = parts_of(near, ids[a], ids[b])
                links[a], links[b] = near @ copies[b], copies[a] @ near
            for k, v in zip(rows, (ids, root, links), strict=True):
                rows[k].append(v)
            held += len(ids)
            if held > 20_000:
                yield as_rows(rows)
                rows, held = {k: [] for k in rows}, 0
        if rows["node"]:
            yield as_rows(rows)

    def as_rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in rows.values()], [*rows])

    n = common.parts(groups.sparkSession, 1)
    return groups.repartition(n, "g").sortWithinPartitions("g").mapInArrow(common.tidied(run), "node long, root long, links long")


def with_sets(rows: DataFrame, n: int) -> DataFrame:
    """Replaces text by its set, packed."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in common.slices(batches, 4 << 20):
            sets = [shingles(t, n).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sets, pa.binary())], [*keep, "set"])

    return rows.select(*keep, "text").mapInArrow(common.tidied(run), rows.drop("text").schema.add("set", "binary"))


def linked(docs: DataFrame, similarity: tuple[int, int] = (4, 5), n: int = 5, recall: float = 0.9999,
           limit: int = 4096, small: int = 256, block: int = 4096) -> DataFrame:
    """doc_id, th, class_id, n_links and stays (whether the row stands for its class) of every row."""
    spark = docs.sparkSession
    s = similarity[0] / similarity[1]
    least = least_agreeing(s)
    base = common.cut(sketched(docs, runs_needed(s, recall, deepest_level(limit, small)), n), "sketches")
    live = base.filter("sig is not null and doc_id is not null")
    nodes = live.groupBy("sig").agg(
        F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")
    )
    # numbered as they are written, once: a doc_id may stand for several texts
    nodes = common.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select(F.explode("keys").alias("bucket"), "node", "sketch")
    proposed = graph.components(proposed_links(split_hot(rows, limit), least, small))
    member = proposed.unionAll(proposed.select(F.col("root").alias("node"), "root").distinct())
    member = member.join(nodes.select("node", "copies", "first"), "node")
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = common.cut(member.join(sizes, "root").select("node", "copies", "root", "blocks", "first.doc_id", "first.th"), "members")
    # members grow with the corpus: they are merged with the texts at every size, never sent to all tasks
    sets = with_sets(identified(docs).hint("merge").join(member, ["doc_id", "th"]).select("node", "copies", "root", "blocks", "text"), n)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sets = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    groups = sets.select(F.xxhash64("root", lo, hi).alias("g"), (lo != hi).alias("cross"), "node", "copies", "mine", "set")
    found = common.cut(verified(groups, *similarity), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = graph.components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    classes = common.cut(classes.unionAll(classes.select(F.col("root").alias("node"), "root").distinct()), "classes")
    names = classes.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("name"))
    classes = classes.join(names, "root").select("node", "name")
    known = nodes.select("sig", "node", "copies", "first").join(links, "node", "left").join(classes, "node", "left")
    out = base.select("doc_id", "th", "sig").join(known, "sig", "left")
    live = F.col("doc_id").isNotNull() & F.col("node").isNotNull()
    name = F.coalesce("name", "first")
    return out.select(
        "doc_id",
        "th",
        F.when(live, name["doc_id"]).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(live, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(live, (name["doc_id"] == F.col("doc_id")) & (name["th"] == F.col("th"))).otherwise(F.lit(True)).alias("stays"),
    )


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links of every row.

    n_links counts the other rows whose set is at least similarity (a fraction) alike, copies included; class_id is the
    least doc_id reachable over links. Texts without a word (null, empty, blank) and rows without a doc_id link to
    nothing: their class is their own id. Rows that repeat a doc_id with the same text count as copies; with another
    text they are documents of their own, in classes of their own (which may be named by the same id). Very long texts
    are taken whole. An empty table gives no row. Only doc_id and text are read, so other columns may have any name.
    """
    return linked(docs, **how).select("doc_id", "class_id", "n_links")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, the one of least doc_id (then of least text hash), with its own columns; of rows
    repeating doc_id and text, one. Rows without a doc_id, and rows whose text has no word, all stay."""
    found = common.cut(linked(docs, **how), "near-duplicates")
    wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    th = lambda: F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    gone = found.filter("not stays").select("doc_id", "th").distinct()
    left = docs.join(gone, (docs["doc_id"].cast("long") == gone["doc_id"]) & (th() == gone["th"]), "left_anti")
    twice = found.filter("doc_id is not null and stays").groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th")
    if twice.isEmpty():
        return left
    same = (left["doc_id"].cast("long") == twice["doc_id"]) & (F.xxhash64(F.coalesce(left["text"], F.lit(""))) == twice["th"])
    again = left.join(twice, same, "left_semi")
    return left.join(twice, same, "left_anti").unionAll(again.filter(wordless)).unionAll(again.filter(~wordless).dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op5_jaccard over the whole documents table: five words, similarity 0.8."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
