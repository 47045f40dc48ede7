"""Top-k search against brute force; the mix against its definition."""

import hashlib
import math

import numpy as np
import pytest

from orrery.llm import common, mixture, topk

from .conftest import CLASH


def brute(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_k_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET_ROWS", (60, 60))
    monkeypatch.setattr(topk, "QUERY_ROWS", (8, 8))
    monkeypatch.setattr(topk, "SEEDS", 40)
    r = np.random.default_rng(3)
    base = r.standard_normal((6, 8))
    rows = [(i, ((base[i % 6] + 0.2 * r.standard_normal(8)) * math.exp(spread * r.standard_normal())).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector very often
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (2060, [float("inf")] + [0.0] * 7), (2080, [0.0] * 8), (-20, [1.0] * 8)]
    got = sorted(map(tuple, topk.top_k(frame(spark, [(i, v, 0) for i, v in rows])).collect()))
    assert got == brute(rows)


def test_vectors_travel_only_to_blocks_that_ask(spark, monkeypatch):
    """Few long vectors, many short ones: the short ones' buckets are out of every query's reach."""
    monkeypatch.setattr(topk, "BUCKET_ROWS", (50, 50))
    monkeypatch.setattr(topk, "QUERY_ROWS", (5, 5))
    monkeypatch.setattr(topk, "SEEDS", 60)
    sent = []
    real = topk.meetings
    monkeypatch.setattr(topk, "meetings", lambda *a: (sent.append((a[1].select("block").distinct().count(), a[0].count(), real(*a).count())), real(*a))[1])
    r = np.random.default_rng(9)
    rows = [(i, (np.abs(r.standard_normal(6)) * (100 if i < 80 else 0.05)).astype(np.float32).tolist()) for i in range(1000)]
    got = sorted(map(tuple, topk.top_k(frame(spark, [(i, v, 0) for i, v in rows])).collect()))
    assert got == brute(rows)
    blocks, n, moved = sent[0]
    assert blocks > 3 and n == 1000 and moved < n * blocks / 4


def test_coordinates_prune_without_loss():
    r = np.random.default_rng(5)
    p = np.rint(r.standard_normal((2000, 8)) * 40).astype(np.int64)
    q = p[:10] + 1
    s = q @ p.T
    bound = -np.sort(-s, 1)[:, 4].astype(float)
    best = topk.Best(10, 5, bound)
    used = topk.search_bucket(best, q, np.full(10, -1), p, np.arange(2000))
    assert used["coordinate"] > 0 and used["coordinate"] + used["length"] < 10 * 2000
    for j in range(10):
        want = sorted((-x, i) for i, x in enumerate(s[j]))[:5]
        assert sorted((-a, b) for a, b, c in zip(best.score, best.id, best.row, strict=True) if c == j) == want


@pytest.mark.parametrize("sign", [-1, 1])
@pytest.mark.parametrize("width", [2, 4, 64])
def test_neighbours_along_an_axis_stay(sign, width):
    r = np.random.default_rng(8)
    axis = np.zeros(width)
    axis[1] = 640.0 * sign
    p = np.rint(axis + r.standard_normal((1500, width)) * r.choice([0, 3, 40, 200], (1500, 1)) / math.sqrt(width)).astype(np.int64)
    q = np.concatenate([np.rint(axis)[None].astype(np.int64), p[r.choice(1500, 20)]])
    s = q @ p.T
    for share in (0.65, 0.9, 0.99):
        bound = share * np.sqrt((q**2).sum(1)) * np.sqrt((p**2).sum(1)).max()
        best = topk.Best(len(q), 1500, bound.astype(float))
        used = topk.search_bucket(best, q, np.full(len(q), -1), p, np.arange(1500))
        assert used["coordinate"] > 0
        got = set(zip(best.row.tolist(), best.id.tolist(), strict=True))
        assert got == {(j, i) for j, i in zip(*(x.tolist() for x in np.nonzero(s >= bound[:, None])), strict=True)}


def test_few_or_no_vectors(spark):
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0], 0)])).count() == 0
    got = topk.top_k(frame(spark, [(0, [1.0], 0), (20, [2.0], 0), (20, [2.0], 0), (7, [3.0], 0)])).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 12288), (0, 2, 20, 8192), (0, 3, 20, 8192), (20, 1, 7, 24576), (20, 2, 0, 8192)]


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            t[s] += share[s]
            if t[s] > cap * sizes[s]:
                left += t[s] - cap * sizes[s]
                t[s] = float(cap * sizes[s])
                open_.discard(s)
    return t


SOURCES = {"b": 400, "B": 30, "é": 50, None: 5, "zz": 1, "a": 90}


def corpus(make):
    rows, i = [], 0
    for s, n in SOURCES.items():
        for k in range(n):
            rows.append((i, " ".join(["w"] * (k % 7)) if k % 11 else None, "en", s))
            i += 1
    return make([*rows, (5, "again here", "en", "b"), (None, "no id", "en", "b"), (None, "nor this one", "en", "b")], **CLASH)


def test_mix(spark, make):
    docs = corpus(make)
    m = mixture.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = fill(sizes)
    assert len(m) == docs.count()
    taken = {}
    for r in m:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = sorted(map(str, mixture.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(str, m))


def test_positions_follow_the_schedule(make):
    rows = [(i, "one two three", "en", "ab"[i % 2]) for i in range(2000)]
    c = mixture.curriculum(make(rows)).collect()
    at = [r.position for r in c if r.position is not None]
    assert at == sorted(at)
    early = {s: sum(r.source == s and r.position is not None and r.position < 0.5 for r in c) / sum(r.source == s and r.taken > 0 for r in c) for s in "ab"}
    # "a" starts at 1.5 times its mean weight: 5/8 of its demand lies in the first half; "b" is level. Repeats begin a round
    # later, so only first copies count here, which come no later than their share
    assert early["a"] > early["b"] * 0.9


def test_mixed_documents_are_whole_and_repeated(make):
    docs = corpus(make)
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id, r.text] = n.get((r.doc_id, r.text), 0) + 1
    for r in mixture.mix(docs).collect():
        if r.taken > r.size and r.doc_id not in (5, None):
            assert max(v for (i, _), v in n.items() if i == r.doc_id) == math.ceil(r.taken / r.size)


def slow_order(docs):
    """(doc_id, text) of each copy in order of training time."""
    target = {r.source: r.target for r in mixture.mix(docs).collect()}
    names = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None] * (None in target)
    at = []
    for k, s in enumerate(names):
        quota, start = math.floor(target[s] + 0.5), mixture.STARTS[k % 3]
        rows = []
        for r in docs.collect():
            if r.source == s:
                name = f"null{hashlib.md5((r.text or '').encode()).hexdigest()}" if r.doc_id is None else str(r.doc_id)
                rows.append((hashlib.md5(f"{name}:mix".encode()).hexdigest(), -1 if r.doc_id is None else r.doc_id, len((r.text or "").split()), r.doc_id, r.text))
        rows.sort()
        total = sum(r[2] for r in rows)
        for e in range(3):
            offset = e * total
            for h, _, size, i, text in rows:
                if size and offset < quota:
                    x = offset / quota
                    at.append((x * 2 / (start + math.sqrt(max(start * start + (1 - start) * x * 4, 0))), h, e, i, text))
                offset += size
    return [(i, text) for _, _, _, i, text in sorted(at, key=lambda a: a[:3])]


def test_mixed_documents_stand_in_order_of_time_and_can_be_read_so(spark, make):
    docs = corpus(make)
    want = slow_order(docs)
    out = mixture.mixed_documents(docs)
    assert [(r.doc_id, r.text) for r in out.collect()] == want
    back = common.in_place(common.cut(out, "mixed"), "f", "n").orderBy("f", "n").collect()
    assert [(r.doc_id, r.text) for r in back] == want and back[0].taken == 10


def test_mix_of_nothing(make):
    assert mixture.mixed_documents(make([])).count() == 0
    assert mixture.mixed_documents(make([(1, None), (2, ""), (None, " \n")])).count() == 0
    assert mixture.mix(make([])).count() == 0
    r = mixture.mix(make([(1, None), (2, "")])).collect()
    assert [(x.size, x.taken, x.target) for x in r] == [(0, 0, 0.0)] * 2
