"""The language model: base scores, forward pass, gradients and triples against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import attention, bpe, lm, sstable

from .conftest import CLASH
from .test_text_operators import prose


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


ROWS = [(i, prose(30 + 9 * (i % 20), i).upper() if i % 3 else prose(30, i)) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, "Ünseen\xa0x zzzz"), (None, "abc"), (5, prose(30, 5)), (61, ROWS[3][1]), (62, ROWS[3][1]), (63, "q" * 3000), (64, " ".join(prose(40, 4).split() * 5))]


def slow_attention(w, v, ids, end):
    """For each token of one stream: log probability, and the log of the chance that it opens a word."""
    w = {k: x.astype(np.float64) for k, x in w.items()}
    out = []
    rows = v.input_of[np.concatenate([[end], ids[:-1]])]
    soft = lambda y: np.exp(y - y.max()) / np.exp(y - y.max()).sum()
    for t, target in enumerate(ids.tolist()):
        block = t // attention.STEP
        first = max(block - 1, 0) * attention.STEP
        place = [(u - block * attention.STEP) + attention.STEP for u in range(first, t + 1)]
        x = w["E"][rows[first : t + 1]] + w["P"][place]
        q = x[-1] @ w["q"]
        a = soft(x @ w["k"] @ q / math.sqrt(len(q)))
        z = x[-1] + (a @ (x @ w["v"])) @ w["o"]
        p = soft(z @ w["U"] + w["b"])
        g = v.group_of[target]
        lp = math.log(p[g]) + v.log_share[target]
        if v.told_apart[g]:
            lp += math.log(soft(z @ w["M"][v.slot[g]] + w["c"][v.slot[g]])[v.place_of[target]])
        out.append((lp, math.log(p[: v.opening].sum())))
    return out


def test_scores_against_brute_force(make, monkeypatch):
    caught = {}
    real = lm.trained
    monkeypatch.setattr(lm, "trained", lambda src, tok, counts, *a: caught.setdefault("w", (real(src, tok, counts, *a), counts))[0])
    docs = make(ROWS, **{k: v for k, v in CLASH.items() if k != "held_out"})
    got = lm.language_model(docs, bpe.default_tokenizer()).collect()
    weights, counts = caught["w"]
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    vocab = tok.get_vocab_size()
    v = attention.Vocabulary(counts, np.array([(tok.id_to_token(i) or "").startswith("Ġ") for i in range(vocab)] + [True]))
    tokens = [(i, [*words_of(t), 0]) for i, t in ROWS]
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    three = collections.Counter(x for i, ws in tokens if not held(i) for x in zip([1, 1, *ws], [1, *ws], ws, strict=False))
    context, kinds = collections.Counter(), collections.Counter()
    for (a, b, _), c in three.items():
        context[a, b] += c
        kinds[a, b] += 1
    once, twice = (sum(c == k for c in three.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    n, distinct = sum(count.values()), len(count)
    ids_seen = collections.Counter()
    want = collections.defaultdict(list)
    for i, ws in tokens:
        subs = [tok.encode(" " + w, add_special_tokens=False).ids if w else [vocab] for w in ws]
        if not held(i):
            ids_seen.update(x for s in subs for x in s)
        ids = np.array([x for s in subs for x in s])
        scored = slow_attention(weights, v, ids, vocab)
        score, at = 0.0, 0
        for k, (w, s) in enumerate(zip(ws, subs, strict=True)):
            lp = sum(x for x, _ in scored[at : at + len(s)]) - scored[at][1] + (scored[at + len(s)][1] if w else 0)
            at += len(s)
            low = lm.ATTENTION_SHARE * math.exp(lp) + (1 - lm.ATTENTION_SHARE) * count[w] / n
            h = tuple(([1, 1] + ws)[k : k + 2])
            p = low
            if context[h]:
                p = (max(three[(*h, w)] - d, 0) + d * kinds[h] * low) / context[h]
            score += math.log10(p) if p else lp / math.log(10) + math.log10(lm.ATTENTION_SHARE)
        base = sum(math.log10((count[w] + 1) / (n + distinct + 1)) for w in ws)
        want[i].append((held(i), len(ws), sum(count[w] > 0 for w in ws), n, base, score))
    assert {i: c for i, c in ids_seen.items()} == {i: c for i, c in enumerate(counts.tolist()) if c}
    have = collections.defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert sorted(have, key=str) == sorted(want, key=str)
    for i, rows in want.items():
        for a, b in zip(sorted(rows), sorted(have[i]), strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=2e-4, abs=1e-3), i


def test_nothing_to_learn_from(make):
    assert lm.language_model(make([]), bpe.default_tokenizer()).count() == 0
    out = next(i for i in range(100) if held(i))
    rows = lm.language_model(make([(out, "some words"), (out, None)]), bpe.default_tokenizer()).collect()
    assert [r.train_tokens for r in rows] == [0, 0] and all(r.score < 0 and math.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("text", [b"", b" ", b"a", b"word " * 500, b"x" * 5000, b"  lead \n\t" * 300, b"q" * 511 + b" end", b"q" * 512 + b" end"])
def test_every_training_document_has_its_turn(text):
    """One segment in `of` is due, whatever the number of documents; over all turns, each word exactly once."""
    due = [s for turn in range(16) for s in lm.segments(text, turn, range(1), 16)]
    assert collections.Counter(w for words, _, _ in due for w in words) == collections.Counter(text.split())
    assert all(16 * len([0 for _ in lm.segments(text, t, range(1), 16)]) <= -(-len(text) // lm.SEGMENT) + 16 for t in range(16))


def test_planes():
    x = np.array([0, 1, 255, 256, (1 << 40) - 1], np.uint64)
    assert lm.from_planes(lm.planes(x, 5)).tolist() == x.tolist() and lm.planes(x[:0], 5).shape == (5, 0)


def test_words_sum_to_one_over_a_context():
    """Discounted triples and the layer below share one unit of probability."""
    triple, kinds, d = np.array([5, 1, 1, 0, 0]), 3, 0.7
    low = np.array([0.1, 0.2, 0.3, 0.25, 0.15])
    # the layer below, as if attention alone made it
    logs = lm.word_logs(np.log(low), low, triple, np.full(5, 7), np.full(5, kinds), d)
    assert np.exp(logs).sum() == pytest.approx(1)


# -------------------------------------------------------------- attention


@pytest.fixture
def small():
    counts = np.random.default_rng(3).integers(0, 50, 500)
    return attention.Vocabulary(counts, np.arange(500) % 3 == 0, inputs=64, own=3, shared=2)


def test_groups(small):
    v, opens = small, np.arange(500) % 3 == 0
    assert v.input_of.max() == 63 and v.groups == len(v.told_apart)
    assert (v.group_of[opens] < v.opening).all() and (v.group_of[~opens] >= v.opening).all()
    alone = ~v.told_apart[v.group_of]
    sums = np.bincount(v.group_of[alone], np.exp(v.log_share[alone].astype(float)), v.groups)
    assert sums[~v.told_apart] == pytest.approx(np.ones((~v.told_apart).sum()), abs=1e-4)
    apart = v.group_of[~alone].astype(np.int64) * attention.MEMBERS + v.place_of[~alone]
    assert len(set(apart.tolist())) == len(apart)


def windows(v, r, n=3):
    cur, prev = r.integers(0, v.inputs, (2, n, attention.STEP))
    target = r.integers(0, 500, (n, attention.STEP))
    target[2, 5:] = -1
    return cur, prev, np.array([True, False, False]), target


def test_gradients(small):
    r = np.random.default_rng(0)
    m = attention.Model(small, width=6)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    cur, prev, opens, target = windows(small, r)
    _, g = m.loss_and_gradients(cur, prev, opens, target)
    for name in m.w:
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in m.w[name].shape)
            at = (int(cur[0, 0]), 1) if name == "E" else at
            was = m.w[name][at]
            m.w[name][at] = was + 1e-5
            up = m.loss_and_gradients(cur, prev, opens, target)[0]
            m.w[name][at] = was - 1e-5
            down = m.loss_and_gradients(cur, prev, opens, target)[0]
            m.w[name][at] = was
            assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), name


def test_scores_sum_to_one_and_equal_the_training_loss(small):
    m = attention.Model(small, width=6)
    r = np.random.default_rng(1)
    lengths = np.array([3, 2 * attention.STEP + 4, 1, attention.STEP])
    ids = r.integers(0, 500, lengths.sum())
    cur, opens, into = attention.blocks(small.input_of[ids], lengths, 63)
    assert cur.reshape(-1)[into].tolist() == [63 if k == 0 else small.input_of[ids[a + k - 1]] for a, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True) for k in range(n)]
    total, opening, chance = 0, 0, None
    for c in range(500):
        target = np.full(cur.shape, c)
        lp, chance = m.log_probabilities(cur, opens, target)
        if c < 4:
            loss, _ = m.loss_and_gradients(cur, attention.previous(cur), opens, target)
            assert lp.mean() == pytest.approx(-loss, rel=1e-4)
        total = total + np.exp(lp.astype(float))
        opening = opening + (c % 3 == 0) * np.exp(lp.astype(float))
    assert total == pytest.approx(np.ones(cur.shape), abs=1e-3)
    assert opening == pytest.approx(np.exp(chance.astype(float)), abs=1e-3)
    some = np.where(r.random(cur.shape) < 0.5, 7, -1)
    parts = m.log_probabilities(cur, opens, some, group=2, inner=1)[0]
    assert parts == pytest.approx(np.where(some == 7, m.log_probabilities(cur, opens, np.full(cur.shape, 7))[0], 0), abs=1e-4)


def test_a_token_sees_only_what_came_before(small):
    m = attention.Model(small, width=6)
    ids = np.random.default_rng(2).integers(0, 64, 70)

    def run():
        cur, opens, into = attention.blocks(ids, np.array([70]), 11)
        return m.log_probabilities(cur, opens, np.zeros(cur.shape, int))[0].ravel()[into]

    a = run()
    ids[30:] = (ids[30:] + 1) % 64
    b = run()
    assert a[:31] == pytest.approx(b[:31], abs=1e-5) and not np.allclose(a[31:], b[31:])


def test_large_scores_do_not_overflow():
    y = np.array([[1e4, 0, -1e4], [-1e4, -1e4 + 1, -2e4]], np.float32)
    p = y.copy()
    logs = attention.softmax(p, 2e4)
    assert p[0].tolist() == [1, 0, 0] and p.sum(1) == pytest.approx([1, 1]) and logs[0] == pytest.approx(1e4)


def test_large_weights_score_as_the_slow_way(small):
    m = attention.Model(small, width=6)
    r = np.random.default_rng(7)
    for k in m.w:
        m.w[k] = m.w[k] * np.float32(6)
    cur, opens, into = attention.blocks(r.integers(0, 64, 50), np.array([50]), 63)
    target = r.integers(0, 500, cur.shape)
    lp, _ = m.log_probabilities(cur, opens, target)
    loss, _ = m.loss_and_gradients(cur, attention.previous(cur), opens, target)
    assert np.isfinite(lp).all() and lp.mean() == pytest.approx(-loss, rel=1e-3)


def test_words_are_encoded_as_the_library_does():
    tok, enc = Tokenizer.from_file(bpe.default_tokenizer()), sstable.encoder(bpe.default_tokenizer())
    words = ["the", "the", "x.", "|", "a|", "1st", "Ünï,", "ꙮ", "ꙮ.", "don't", "<|endoftext|>", "zz..", "\u200bq", "a" * 300, "été", "x,"]
    flat, size = enc.words(words)
    parts = np.split(flat, np.cumsum(size)[:-1])
    assert [p.tolist() for p in parts] == [tok.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert [x.size for x in enc.words([])] == [0, 0]


def test_training_helps():
    ids = np.tile(np.arange(6), 400)
    v = attention.Vocabulary(np.bincount(ids, minlength=8), np.arange(8) < 3, inputs=8, own=2, shared=1)
    cur, opens, into = attention.blocks(v.input_of[ids], np.array([len(ids)]), 7)
    target = np.full(cur.size, -1, np.int64)
    target[into] = ids
    t = attention.Trainer(attention.Model(v), batch=32)
    for _ in range(20):
        t.take(cur, attention.previous(cur), opens, target.reshape(cur.shape))
    assert t.losses[-1] < 0.3 * t.losses[0]


def test_the_model_is_trained_on_every_word_once():
    text = b" ".join(b"w%d" % i for i in range(2000))
    for turn in range(5):
        asked = []
        for chosen in (range(1), range(1, 4)):
            for words, lead, _ in lm.led(text, turn, chosen, lm.EVERY * 4):
                first = int(words[0][1:])
                assert words == [b"w%d" % i for i in range(first, first + len(words))] and (lead > 5 or first == 0)
                asked += words[lead:]
        assert sorted(asked, key=lambda w: int(w[1:])) == text.split()


def test_a_step_is_adams_over_one_array_of_all_weights(small):
    v = small
    model, plain = attention.Model(v), attention.Model(v)
    trainer = attention.Trainer(model, warm=1)
    assert all(np.shares_memory(w, trainer.all) for w in model.w.values())
    r = np.random.default_rng(7)
    ids = r.integers(0, len(v.group_of), 40 * attention.STEP)
    cur, opens, _ = attention.blocks(v.input_of[ids], np.array([len(ids)]), 0)
    target = ids.reshape(cur.shape)
    at = np.random.default_rng(11).permutation(len(cur))
    _, g = plain.loss_and_gradients(cur[at], attention.previous(cur)[at], opens[at], target[at])
    trainer.take(cur, attention.previous(cur), opens, target)
    for k, w in plain.w.items():  # a first step goes by the rate along each gradient's sign
        np.testing.assert_allclose(model.w[k], w - trainer.rate / np.sqrt(1 + 1 / 200) * g[k] / (np.abs(g[k]) + 1e-8), atol=1e-5)


def test_a_task_encodes_a_word_once_however_often_it_trains(monkeypatch):
    import pyarrow as pa

    enc, asked, steps = sstable.encoder(bpe.default_tokenizer()), [], []
    words, take = enc.words, attention.Trainer.take
    monkeypatch.setattr(lm, "FLUSH", 100)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda _: 0})())
    monkeypatch.setattr(enc, "words", lambda w: asked.extend(w) or words(w))
    monkeypatch.setattr(attention.Trainer, "take", lambda self, *a: steps.append(int((a[3] >= 0).sum())) or take(self, *a))
    texts = [prose(60, k) for k in range(12)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([k], pa.int64()), "text": [t]}) for k, t in enumerate(texts)]
    list(lm.train_model(iter(batches), bpe.default_tokenizer(), np.ones(enc.size + 1, np.int64), None, range(4), 4))
    assert len(steps) > 3 and len(asked) == len(set(asked)) and set(asked) == {w for t in texts for w in words_of(t)}
    assert sum(steps) == sum(len(enc.tok.encode("".join(" " + w for w in words_of(t)), add_special_tokens=False).ids) + 1 for t in texts)


def test_streams_of_a_task_hold_the_librarys_ids():
    enc = sstable.encoder(bpe.default_tokenizer())
    known = lm.TaskWords(enc, enc.size, most=4)
    for words in (["the", "zzxq.", "the"], ["zzxq.", "of", "ünd"], ["the", "of"]):  # more than 4 are met: they are forgotten
        held = [(known.numbers([w.encode() for w in words], True), 1), (known.numbers([words[0].encode()], False), 0), (known.numbers([], True), 0)]
        ids, lengths, silent = known.streams(held)
        subs = [enc.tok.encode(" " + w, add_special_tokens=False).ids for w in words]
        assert ids.tolist() == [*(x for s in subs for x in s), enc.size, *subs[0], enc.size]
        assert lengths.tolist() == [sum(map(len, subs)) + 1, len(subs[0]), 1] and silent.tolist() == [len(subs[0]), 0, 0]
    assert len(known.number) == 3


def test_windows_scored_in_a_row_equal_windows_alone(small):
    """A block looked up once, as the current one of a window and the earlier one of the next, gives what training computes."""
    m, r = attention.Model(small, width=6), np.random.default_rng(4)
    cur, opens = r.integers(0, 64, (9, attention.STEP)), np.arange(9) % 4 == 0
    rows, places = m.projected()
    x, xq, q, kv, a, _ = m.attended(np.concatenate([attention.previous(cur), cur], 1), opens)
    attention.softmax(a, 80)
    want = xq + (a @ kv[:, 6:].reshape(9, -1, 6)).reshape(-1, 6) @ m.w["o"]
    have = m.hidden(np.concatenate([cur[:1], cur]), opens, None, rows, places)
    np.testing.assert_allclose(have, want, atol=2e-5)


def test_great_scores_of_many_rows_keep_their_gradient():
    s = np.full((40_000, 64), 74, np.float32)
    loss = attention.chosen_less(s, np.zeros(len(s), np.int64), np.float32(len(s)))
    assert loss / len(s) == pytest.approx(-math.log(64), rel=1e-4)
    assert s[:, 0] * len(s) == pytest.approx(np.full(len(s), 1 / 64 - 1), rel=1e-3) and s[:, 1] * len(s) == pytest.approx(np.full(len(s), 1 / 64), rel=1e-3)
