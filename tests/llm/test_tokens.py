"""BPE by forced boundaries and sorted-string-table shards, against the tokenizers library."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import bpe, common, sstable

from .conftest import CLASH

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "\n", "a", "  a  b ", "don't I'LL we've", "x" * 3000 + " " + "ab" * 700, "a<|endoftext|>b<|endoftext|>", "日本語 テスト", "😀😀 á́", "\r\n\t \n a", "\x1c\x1d x", "\xa0a b", "tab\tin", "a\0b"]


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abst'é ,.1\n\t|—<>endoftx", "<|endoftext|>"]), max_size=60).map("".join))
def test_encoders_equal_the_library(text):
    assert bpe.ids_of(bpe.loaded(PATH), [text])[0].tolist() == want(text)
    assert [x[0].tolist() for x in (sstable.encoder(PATH).encode_many([text]), sstable.encoder(PATH).whole_texts([text]))] == [want(text)] * 2


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_unicode(text):
    ids = bpe.ids_of(bpe.loaded(PATH), [text])[0].tolist()
    assert ids == want(text)
    assert sstable.encoder(PATH).encode_many([text])[0].tolist() == ids
    assert bpe.loaded(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


WORLD = ["سلام عليكم 12", "שלום עולם", "नमस्ते दुनिया", "สวัสดี ชาวโลก", "Ёлка и ёж", "Αθήνα ώρα", "你好，世界。「x」", "ok 😀 fine", "e\u0301t\u00e9 caf\u00e9", "a\u180eb c", "x\u200b y", "ꙮ ok", "1\u0660٣ a", "a \u3000 b", "\ufeffabc d"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"".join(WORLD), " ", " ", "\n", "the", "|"]), max_size=30).map("".join))
def test_scripts_of_the_world(text):
    assert bpe.ids_of(bpe.loaded(PATH), [text])[0].tolist() == want(text)
    assert sstable.encoder(PATH).encode_many([text])[0].tolist() == want(text)


def test_settled_characters_are_classed_alike():
    """Every character of the list, between letters, digits, signs and spaces."""
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and bpe.SETTLED.fullmatch(chr(c))]
    assert len(every) > 30_000
    texts = [f"a{c}b 1{c}2 .{c}, {c} {c}{c}" for c in every]
    for a in range(0, len(texts), 2000):
        some = texts[a : a + 2000]
        got = [x.tolist() for x in bpe.ids_of(bpe.loaded(PATH), some)]
        assert got == [e.ids for e in LIBRARY.encode_batch_fast(some, add_special_tokens=False)]


def test_only_pieces_with_unsettled_characters_go_to_the_library(monkeypatch):
    b = bpe.ForcedBoundaryBPE(PATH)
    asked = []
    real = b._by_library
    monkeypatch.setattr(b, "_by_library", lambda pieces: asked.extend(pieces) or real(pieces))
    text = "plain words before ꙮword and behind\nnext  line ꙮ2 and more"
    assert b.encode(text).tolist() == want(text) and sorted(asked) == [" ꙮ2", " ꙮword"]


def test_cuts_are_forced():
    b = bpe.loaded(PATH)
    whole = list(b.vocab)
    for token in whole[:5000]:
        assert b.cuts(token) == [token]
    assert len(b.cuts(b"a\x00b")) > 1 and b"".join(b.cuts(b"a\x00b")) == b"a\x00b"


def test_long_fragments_merge_alike():
    b = bpe.loaded(PATH)
    for n in (511, 512, 513, 1400):
        t = ("ababba" * n)[:n].encode()
        ids = [*map(b.first.__getitem__, t)]
        assert b._merged_long(list(ids)) == want(t.decode())


def test_digests(make):
    rows = list(enumerate(ODD)) + [(3, "\n"), (None, "x")]
    got = bpe.encode_digest(make(rows, **CLASH), PATH).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    exp = []
    for i, t in rows:
        ids = want(t)
        exp.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=key) == sorted(exp, key=key)


def test_shard_round_trip_and_lookup():
    rng = np.random.default_rng(1)
    rows = {i * 3 - 50: rng.integers(0, 50000, rng.integers(0, 400)).astype("<u4") for i in range(500)}
    w = sstable.ShardWriter(2, block_bytes=4096)
    for i in sorted(rows):
        w.add(sstable.key_of(i), rows[i])
    data = w.finish()
    r = sstable.ShardReader(data)
    assert [sstable.id_of(k) for k, _ in r] == sorted(rows)
    assert r.n_records == 500 and r.n_ids == sum(map(len, rows.values())) and len(r.blocks) > 5
    lazy = sstable.ShardReader(io.BytesIO(data))
    for i in (-50, 7, 1447):
        lazy.blocks_read = 0
        assert [x.tolist() for x in lazy.get(sstable.key_of(i))] == ([rows[i].tolist()] if i in rows else [])
        assert lazy.blocks_read <= 2
    false = sum(r.may_hold(sstable.key_of(i)) for i in range(10_000, 12_000))
    assert false < 60  # about one in a hundred


def test_shard_edges():
    empty = sstable.ShardReader(sstable.ShardWriter(2).finish())
    assert list(empty) == [] and empty.get(sstable.key_of(1)) == []
    w = sstable.ShardWriter(4, block_bytes=10)
    for i, v in ((None, [70000]), (-1, []), (5, [1]), (5, [2])):
        w.add(sstable.key_of(i), np.array(v, "<u4"))
    with pytest.raises(ValueError):
        w.add(sstable.key_of(4), np.array([1], "<u4"))
    data = w.finish()
    r = sstable.ShardReader(data)
    assert [sstable.id_of(k) for k, _ in r] == [None, -1, 5, 5]
    assert [x.tolist() for x in r.get(sstable.key_of(5))] == [[1], [2]]
    broken = bytearray(data)
    broken[1] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.ShardReader(bytes(broken)))
    with pytest.raises(ValueError, match="not a shard"):
        sstable.ShardReader(bytes(100))


def written(spark, docs, **how):
    out = common.shared_dir(spark, "test-sst")
    m = sstable.write_shards(docs, out, PATH, **how)
    return sstable.read_shards(spark, out, m), m


def test_files_hold_all_documents_in_order(spark, make):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 6)]
    got, manifest = written(spark, make(rows, **CLASH), shard_bytes=2000)
    got = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    assert manifest.count() > 4
    start = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0], r[1] or "")), got, strict=True):
        ids = np.array([*want(t), 0], "<u4")
        assert (r[0], r[1], r[2]) == (i, start, len(ids))
        assert r[3] == zlib.crc32(ids.tobytes()) or sum(x == i for x, _ in rows) > 1
        start += len(ids)


def test_no_documents(spark, make):
    got, _ = written(spark, make([]))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert bpe.encode_digest(make([]), PATH).count() == 0


def test_the_library_holds_one_text_at_a_time():
    enc, sizes = sstable.LibraryEncoder(PATH), []
    tok = enc.tok

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            sizes.append(len(texts))
            return tok.encode_batch_fast(texts, **kw)

    enc.tok = Counting()
    texts = [t or "" for t in ODD]
    got = enc.whole_texts(texts)
    assert max(sizes) == 1
    assert [x.tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
