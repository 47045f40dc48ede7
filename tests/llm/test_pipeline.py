"""The pipeline stage by stage against brute force, on a small corpus."""

import collections

import corpus_pipeline
import pytest

from orrery.llm import common, mixture

from . import test_text_operators as brute


def test_stages(spark, data, documents):
    want = ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]
    assert [n for n, _ in corpus_pipeline.STAGES] == want
    docs, out = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, data), name)
        out[name] = (before.collect(), docs.collect())
        if name != "token_ids":
            assert docs.columns == documents.columns
    # quality: what the rules say of each text
    before, after = out["quality_rules"]
    kept = {r.doc_id for r in after}
    for r in before:
        n, _, symbols, dup, rep, lines = brute.slow_measure(r.text or "")
        ok = n >= 10 and 100 * rep <= 20 * n and 100 * symbols <= 10 * n and 100 * dup <= 30 * lines
        assert (r.doc_id in kept) == ok or not ok
        assert ok == (r.doc_id in kept), r.doc_id
    # near-duplicates: one of each class
    before, after = out["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, c, _ in brute.slow_classes([(r.doc_id, r.text) for r in before])})
    # repeats: the bytes that stay
    before, after = out["repeated_passages"]
    texts = {r.doc_id: r.text for r in after}
    for i, n, removed, _, _ in brute.slow_removal([(r.doc_id, r.text) for r in before]):
        if i not in texts:
            assert removed and removed >= n - 3
        else:
            assert n - removed - 8 <= len(texts[i].encode()) <= n - removed
    # mix and tokens: whole documents, ids that decode to them
    before, after = out["source_mix"]
    assert {r.text for r in after} <= {r.text for r in before}
    assert collections.Counter(r.doc_id for r in after).most_common(1)[0][1] <= 3
    before, after = out["token_ids"]
    assert len(before) == len(after) and all(r.round_trip for r in after)


def test_ids_stand_in_training_order(spark, data, documents):
    docs = documents.filter("doc_id < 120")
    mixed = mixture.mixed_documents(docs)
    want = [r.doc_id for r in mixed.collect()]
    ids = corpus_pipeline.token_ids(spark, common.cut(mixed, "mixed"), data)
    assert [r.doc_id for r in common.cut(ids, "ids").orderBy("shard", "row").collect()] == want


EDGES = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n", "en", "a"), (None, "no id but words enough to be kept by the rules one two", "en", "b"),
         (4, brute.prose(50, 1), "en", None), (4, brute.prose(50, 1), "en", None), (4, brute.prose(50, 2), None, "a"), (5, brute.prose(50, 1) + " more", "en", "a"),
         (6, brute.prose(30_000, 3), "en", "b"), (7, "x" * 300_000 + " " + brute.prose(12, 4), "en", "b"), (8, "dup " * 100, "en", "b")]


@pytest.mark.parametrize("rows", [EDGES, EDGES[:3], []])
def test_edges_pass_through_every_stage(spark, make, rows, data):
    docs = make(rows, **brute.CLASH)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, data), name)
        got[name] = docs.collect()
        if name != "token_ids":
            assert set(brute.CLASH.items()) <= {(k, v) for r in got[name][:1] for k, v in r.asDict().items()} or not got[name]
    if rows is not EDGES:
        assert not got["token_ids"]
        return
    kept = lambda name: sorted((r.doc_id or 0, len(r.text or "")) for r in got[name])
    sizes = {i: len(t or "") for i, t, *_ in rows}
    assert [i for i, _ in kept("quality_rules")] == [0, 4, 4, 4, 5, 6, 7]
    assert [i for i, _ in kept("near_duplicates")] == [0, 4, 4, 6, 7]
    assert kept("repeated_passages")[3] == (6, sizes[6]) and all(r.round_trip for r in got["token_ids"])
    assert len(got["source_mix"]) == len(got["token_ids"]) and {r.doc_id for r in got["source_mix"]} <= {None, 4, 6, 7}
