"""Operator 8: removal of repeated passages by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller id,
or earlier in its own. A suffix array over all texts would not fit one machine, and texts cannot be compared
block by block with all others; so the suffixes are first brought together:

1. anchors. Of every window of `length` bytes the least hash of its 32-byte strings is marked, so equal
   passages mark the same places. A mark's context is all bytes that a passage over it can hold.
2. marks meet by hash. Equal contexts are folded: all but the first are repeats. Marks with several
   different contexts ask for their bytes.
3. suffix arrays. The contexts of a mark are laid end to end and their suffixes sorted in two stages:
   suffixes smaller than their successors directly, the rest by scanning buckets from left to right. Common
   prefixes of neighbours then tell which passages repeat, and the first of each is kept.

Every place of every text is covered by marks, so nothing is sampled away. Marks and bytes travel in packed
blocks dealt evenly by hash.

Hot marks, those in so many different contexts that they would fill a tenth of a task, never meet: a first look at
some of the documents estimates which they are, and all tasks get the list, which has a few entries for each
partition at most. The passages over a hot mark go each under a hash of its own 100 bytes (128 bits), and of equal
ones a task sends only the first; the owner of the hash keeps the first of all. So no key grows with the corpus in
any task. The list only routes: whatever it holds, the same bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32
NULL_ID = np.int64(-(1 << 63))
BLOCK = "part int, kind int, block binary"
DOCS, SPANS, SITES, MARKS = 0, 1, 2, 3
#: Of how many texts one is looked at for hot marks; contexts to see before a mark is held to be hot.
LOOK, ENOUGH = 8, 16
_P = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P and its inverse to the powers 0..n, modulo 2^64."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        m = max(n, 1 << 16)
        for name, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            x = np.full(m + 1, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["i"]


class Hashes:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def slide(pick, x: np.ndarray, width: int) -> np.ndarray:
    """pick over every window of the width."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = pick(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, hashes: Hashes):
    """Marked places and their hashes. bounds: where documents begin, and the end."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n - GRAM + 1)
    h = hashes.of(start, start + GRAM)
    least = slide(np.minimum, h, w)
    ok = np.zeros(n - length + 1, bool)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= length:
            ok[s : e - length + 1] = True
    least[~ok] = 0
    most = slide(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w)
    at = np.flatnonzero((most == h) & (h != 0))
    return at, h[at]


def merge_spans(doc: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Overlapping or touching spans of one document become one; sorted by document and start."""
    if not len(doc):
        return doc, s, e
    base = doc.astype(np.int64) << np.int64(40)
    order = np.argsort(base + s, kind="stable")
    a, b = (base + s)[order], np.maximum.accumulate((base + e)[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(a) - 1]])
    d = doc[order][first]
    return d, a[first] - (d.astype(np.int64) << np.int64(40)), b[last] - (d.astype(np.int64) << np.int64(40))


def home(ids: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """Which of n parts a document belongs to."""
    return (common.mix64(ids.view(np.uint64) ^ th) % np.uint64(n)).astype(np.int64)


def doc_index(ids: np.ndarray, th: np.ndarray):
    """Distinct documents in order of (id, text hash), and each row's place among them."""
    order = np.lexsort((th, ids))
    i, t = ids[order], th[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]) if len(i) else np.zeros(0, bool)
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    return i[new], t[new], place


def span_blocks(ids, th, s, e, keys):
    """The spans merged and packed for their documents' parts."""
    if not len(ids):
        return
    di, dt, place = doc_index(ids, th)
    d, s, e = merge_spans(place, s.astype(np.int64), e.astype(np.int64))
    yield from dealt(home(di[d], dt[d], len(keys)), keys, SPANS, id=di[d], th=dt[d], s=s.astype(np.uint32), e=e.astype(np.uint32))


def dealt(part: np.ndarray, keys: np.ndarray, kind: int, **arrays):
    """A block for every part that has rows."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    first = common.runs(p)
    arrays = {k: v[order] for k, v in arrays.items()}
    for a, b in common.pieces(first, len(p)):
        yield int(keys[p[a]]), kind, common.pack(**{k: v[a:b] for k, v in arrays.items()})


def as_batch(rows):
    rows = list(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["part", "kind", "block"],
    )


def in_batches(rows, most: int = 32 << 20):
    """Batches of blocks of about `most` bytes: a partition's output is neither held whole nor put in one batch."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield as_batch(held)
            held, size = [], 0
    if held:
        yield as_batch(held)


def fold(m: dict):
    """Marks sorted by hash and context, first occurrence first. Returns (kept marks, repeats' ids, th, s, e)."""
    _, _, place = doc_index(m["id"], m["th"])
    order = np.argsort((place << np.int64(32)) + m["pos"].astype(np.int64), kind="stable")
    both = common.mix64(m["a"] + m["w"] * np.uint64(0x9E3779B97F4A7C15))[order]
    order = order[np.argsort(both, kind="stable")]
    a, w, pos, place = m["a"][order], m["w"][order], m["pos"][order], place[order]
    same = np.concatenate([[False], (a[1:] == a[:-1]) & (w[1:] == w[:-1])]) if len(a) else np.zeros(0, bool)
    again = same.copy()  # the very same place: a repeated row
    again[1:] &= (place[1:] == place[:-1]) & (pos[1:] == pos[:-1])
    # a run's first place may stand in several rows; only later places repeat it
    run = np.maximum.accumulate(np.where(~same, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
    later = same & ~((place == place[run]) & (pos == pos[run])) & ~again
    kept = {k: v[order[~same]] for k, v in m.items()}
    r = order[later]
    p = m["pos"][r].astype(np.int64)
    return kept, m["id"][r], m["th"][r], p - m["left"][r], p + m["right"][r]


def column_ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def text_arrays(batch):
    texts = [t.encode() for t in batch.column("text").to_pylist()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    hashes = Hashes(data)
    th = common.mix64(hashes.of(bounds[:-1], bounds[1:]) + np.diff(bounds).astype(np.uint64))
    return texts, data, bounds, hashes, th


def marks_of(batch, length: int):
    """The batch's texts, bounds, hashes, text hashes and doc ids, and its marks with their contexts."""
    texts, data, bounds, hashes, th = text_arrays(batch)
    at, a = anchors(data, bounds, length, hashes)
    doc = np.searchsorted(bounds, at, "right") - 1
    s = np.maximum(bounds[doc], at - (length - GRAM))
    e = np.minimum(bounds[doc + 1], at + length)
    w = common.mix64(hashes.of(s, e) ^ ((at - s) * 1024 + (e - at)).astype(np.uint64))
    return bounds, hashes, th, column_ids(batch.column("doc_id")), at, a, doc, s, e, w


def hot_marks(narrow: DataFrame, length: int, n: int, hot_from: int | None = None, look: int = LOOK, enough: int = ENOUGH) -> np.ndarray:
    """Sorted hashes of the marks that probably stand in more than `hot_from` different contexts, by default a tenth of a
    partition's share of all marks: so they are ten a partition at most, but for errors of the estimate.

    One text in `look` is read, and of its contexts those with a hash divisible by `every`, about a hundred for each
    hot mark; both choices follow from the content, so copies do not count again.
    """
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if hot_from is None:
        hot_from = max(1, 2 * size // (length - GRAM + 2) // (10 * n))
    every = max(1, hot_from // (100 * look))

    def run(batches):
        for batch in common.slices(batches, 1 << 20):
            *_, a, _, _, _, w = marks_of(batch, length)
            keep = w % np.uint64(every) == 0
            both = np.unique(np.stack([a[keep], w[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], ["a", "w"])

    some = narrow.filter(F.pmod(F.xxhash64("text"), F.lit(look)) == 0)
    seen = some.mapInArrow(common.tidied(run), "a long, w long").distinct().groupBy("a").count()
    hot = seen.filter((F.col("count") * (every * look) > hot_from) & (F.col("count") >= enough)).select("a").collect()
    return np.sort(np.array([r.a for r in hot], np.int64).view(np.uint64))


def passages(hot_at, bounds, hashes: Hashes, doc, s, e, th, ids, length: int) -> dict:
    """All passages over the marks at `hot_at`, each once, in the form of marks (but for `p`): what is before is empty."""
    cover = np.zeros(bounds[-1] + 2, np.int32)
    first, last = s[hot_at], e[hot_at] - length
    fits = last >= first
    np.add.at(cover, first[fits], 1)
    np.add.at(cover, last[fits] + 1, -1)
    at = np.flatnonzero(np.cumsum(cover) > 0)
    doc = np.searchsorted(bounds, at, "right") - 1
    half = at + length // 2
    w = common.mix64(hashes.of(at, half) * np.uint64(_P) + hashes.of(half, at + length))
    return {"a": hashes.of(at, at + length), "w": w, "id": ids[doc], "th": th[doc], "pos": (at - bounds[doc]).astype(np.uint32),
            "left": np.zeros(len(at), np.uint16), "right": np.full(len(at), length, np.uint16), "p": np.ones(len(at), np.uint8)}


def mark_blocks(batches, length: int, keys: np.ndarray, hot: np.ndarray, flush_at: int = 400_000):
    """Stage 1: marks and their contexts, and passages over hot marks; equal ones are folded within the task before they
    travel."""
    held, count = [], 0

    def flush():
        kept, *spans = fold(joined(held))
        yield from dealt(((kept["a"] & np.uint64(0xFFFFFFFF)) % np.uint64(len(keys))).astype(np.int64), keys, MARKS, **kept)
        yield from span_blocks(*spans, keys)

    for batch in common.slices(batches, 1 << 20):
        bounds, hashes, th, ids, at, a, doc, s, e, w = marks_of(batch, length)
        if len(hot) and len(at):
            place = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
            is_hot = hot[place] == a
            if is_hot.any():
                held.append(passages(np.flatnonzero(is_hot), bounds, hashes, doc, s, e, th, ids, length))
                count += len(held[-1]["a"])
                at, a, doc, s, e, w = (x[~is_hot] for x in (at, a, doc, s, e, w))
        if len(at):
            held.append({"a": a, "w": w, "id": ids[doc], "th": th[doc], "pos": (at - bounds[doc]).astype(np.uint32),
                         "left": (at - s).astype(np.uint16), "right": (e - at).astype(np.uint16), "p": np.zeros(len(at), np.uint8)})
            count += len(at)
        if count >= flush_at:
            yield from in_batches(flush())
            held, count = [], 0
    if held:
        yield from in_batches(flush())


def blocks_of(batches, *kinds: int):
    """The task's blocks of the kinds, gathered; blocks of other kinds as they are, at once."""
    found = {k: [] for k in kinds}

    def others():
        for batch in batches:
            for p, k, b in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("block"), strict=True):
                if k in found:
                    found[k].append(common.unpack(b.as_buffer()))
                else:
                    yield p, k, b.as_py()

    return found, others()


def joined(blocks: list[dict]) -> dict | None:
    """Array by array, so that a block's share is let go as soon as it is copied."""
    if not blocks:
        return None
    out = {k: np.concatenate([b.pop(k) for b in blocks]) for k in [*blocks[0]]}
    blocks.clear()
    return out


def site_blocks(batches, keys: np.ndarray):
    """Stage 2: marks of one hash together. Marks with several contexts ask for their documents' bytes. Of passages over
    hot marks the first is kept, the others are repeats."""

    def rows():
        found, other = blocks_of(batches, MARKS)
        yield from other
        if m := joined(found[MARKS]):
            kept, *spans = fold(m)
            yield from span_blocks(*spans, keys)
            kept = {k: v[kept["p"] == 0] for k, v in kept.items()}
            order = np.argsort(kept["a"], kind="stable")
            first = common.runs(kept["a"][order])
            size = np.diff(np.append(first, len(order)))
            ask = order[np.repeat(size, size) > 1]
            if len(ask):
                sites = {k: kept[k][ask] for k in ("a", "id", "th", "pos", "left", "right")}
                del kept, order
                yield from dealt(home(sites["id"], sites["th"], len(keys)), keys, SITES, **sites)

    yield from in_batches(rows())


def doc_blocks(batches, keys: np.ndarray, keep: list[str], block_bytes: int = 12 << 20):
    """Whole documents packed for their parts, many to a block."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches([b.select(keep) for b, _, _ in held]).combine_chunks()
        ids, th = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
        part = home(ids, th, len(keys))
        order = np.argsort(part, kind="stable")
        for a, b in common.pieces(common.runs(part[order]), len(order)):
            at = order[a:b]
            sink, some = pa.BufferOutputStream(), table.take(pa.array(at))
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_table(some)
            yield int(keys[part[at[0]]]), DOCS, common.pack(id=ids[at], th=th[at], rows=sink.getvalue().to_pybytes())

    for batch in common.slices(batches, 1 << 20):
        held.append((batch, column_ids(batch.column("doc_id")), text_arrays(batch)[-1]))
        size += batch.nbytes
        if size >= block_bytes:
            yield as_batch(flush())
            held, size = [], 0
    if held:
        yield as_batch(flush())


def opened(block: dict):
    table = pa.ipc.open_stream(block["rows"]).read_all().combine_chunks()
    return table


def window_blocks(batches, length: int, keys: np.ndarray):
    """Between stages 2 and 3: the bytes that were asked for leave for the mark's part."""

    def rows():
        found, other = blocks_of(batches, DOCS, SPANS, SITES)
        yield from other
        if s := joined(found[SPANS]):
            yield from span_blocks(s["id"], s["th"], s["s"], s["e"], keys)
        sites = joined(found[SITES])
        if not sites:
            return
        order = np.lexsort((sites["th"], sites["id"]))
        sites = {k: v[order] for k, v in sites.items()}
        where = {}
        first = np.flatnonzero(np.concatenate([[True], (np.diff(sites["id"]) != 0) | (sites["th"][1:] != sites["th"][:-1])]))
        for a, b in common.pieces(first, len(order)):
            where[int(sites["id"][a]), int(sites["th"][a])] = (a, b)
        texts, spans, size = [], [], 0

        def flush():
            data = np.frombuffer(b"".join(texts), np.uint8)
            base = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)[:-1]]).astype(np.int64)
            at = np.array(spans, np.int64)
            n = at[:, 1] - at[:, 0]
            at = common.ranges(at[:, 0], n)
            some = {k: v[at] for k, v in sites.items()}
            some["base"] = np.repeat(base, n)
            return cut_windows(some, data, keys)

        while found[DOCS]:
            block = found[DOCS].pop()
            mine = [where.pop((int(i), int(t)), None) for i, t in zip(block["id"], block["th"], strict=True)]
            hit = [k for k, x in enumerate(mine) if x]
            if hit:
                spans += [mine[k] for k in hit]
                new = [t.encode() for t in opened(block).column("text").take(pa.array(hit)).to_pylist()]
                texts += new
                size += sum(map(len, new))
            if size >= 6 << 20:
                yield from flush()
                texts, spans, size = [], [], 0
        if texts:
            yield from flush()

    yield from in_batches(rows())


def cut_windows(s: dict, data: np.ndarray, keys: np.ndarray):
    """Blocks of contexts, for the parts of their marks."""
    left, right = s["left"].astype(np.int64), s["right"].astype(np.int64)
    start, size = s["pos"].astype(np.int64) - left, left + right
    part = ((s["a"] >> np.uint64(7)) % np.uint64(len(keys))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    first = common.runs(part[order])
    for x, y in common.pieces(first, len(order)):
        at = order[x:y]
        body = data[common.ranges(s["base"][at] + start[at], size[at])]
        yield int(keys[part[at[0]]]), SITES, common.pack(a=s["a"][at], id=s["id"][at], th=s["th"][at], start=start[at].astype(np.uint32), size=size[at].astype(np.uint16), body=body)


def suffix_array(text: np.ndarray, depth: int = 104) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least, by two-stage sorting.

    A suffix smaller than its successor is sorted directly. Any other is its first byte before a smaller
    suffix, so scanning the buckets of first bytes from left to right meets it in order: each bucket holds
    first its induced suffixes, then the directly sorted ones.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = np.zeros(n, bool)  # smaller than the successor
    if len(change):
        length = np.diff(np.concatenate([[-1], change]))
        rising[: change[-1] + 1] = np.repeat(text[change + 1] > text[change], length)
    direct = np.flatnonzero(rising)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    words = np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(words, kind="stable")]
    del words
    bucket = text[direct]
    edges = np.searchsorted(bucket, np.arange(257))
    induced = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []

    def scan(suffixes):
        """Places in front of the suffixes that are larger than them go to the ends of their buckets."""
        before = suffixes[suffixes > 0] - 1
        before = before[~rising[before]]
        c = text[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        first = common.runs(c)
        for x, y in common.pieces(first, len(c)):
            induced[c[x]].append(before[x:y])

    for c in range(256):
        k = 0
        while k < len(induced[c]):
            scan(induced[c][k])
            k += 1
        out += induced[c]
        mine = direct[edges[c] : edges[c + 1]]
        if len(mine):
            scan(mine)
            out.append(mine)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix with the one before it in order, no further than `most`; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(most, np.uint8)]), most)
    for at in range(1, len(sa), 1 << 15):
        to = min(at + (1 << 15), len(sa))
        rows = view[sa[at - 1 : to]]
        differ = rows[1:] != rows[:-1]
        out[at:to] = np.where(differ.any(1), differ.argmax(1), most)
    return np.minimum(out, np.minimum(len(text) - sa, np.concatenate([[0], len(text) - sa[:-1]]))) if len(sa) else out


def repeated(w: dict, length: int):
    """ids, th, s, e of the passages that are not the first of their kind among the contexts."""
    size = w["size"].astype(np.int64)
    text, ends = w["body"], np.cumsum(size)
    begin = ends - size
    sa = suffix_array(text, length + 4)
    owner = np.repeat(np.arange(len(size)), size)[sa]
    fits = sa + length <= ends[owner]
    sa, owner = sa[fits], owner[fits]
    lcp = common_prefixes(text, sa, length)
    kind = np.cumsum(lcp < length)
    start = w["start"][owner].astype(np.int64) + sa - begin[owner]
    _, _, place = doc_index(w["id"], w["th"])
    key = (place[owner] << np.int64(32)) + start
    order = np.lexsort((key, kind))
    first = common.runs(kind[order])
    least = np.repeat(key[order][first], np.diff(np.append(first, len(order))))
    late = order[key[order] != least]
    return w["id"][owner[late]], w["th"][owner[late]], start[late], start[late] + length


def repeat_blocks(batches, length: int, keys: np.ndarray, text_bytes: int = 1 << 18):
    """Stage 3: suffix arrays over the contexts of whole marks, about text_bytes at a time."""

    def rows():
        found, other = blocks_of(batches, SITES)
        yield from other
        flat = joined(found[SITES])
        if not flat:
            return
        spans = []
        order = np.argsort(flat["a"], kind="stable")
        size = flat["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        first = common.runs(flat["a"][order])
        weight = np.add.reduceat(size[order], first)
        chunk = (np.cumsum(weight) - weight) // text_bytes
        starts = common.runs(chunk)
        bounds = [*first[starts].tolist(), len(order)]
        for x, y in zip(bounds, bounds[1:], strict=False):
            at = order[x:y]
            w = {k: flat[k][at] for k in ("id", "th", "start", "size")}
            w["body"] = flat["body"][common.ranges(begin[at], size[at])]
            i, t, s, e = repeated(w, length)
            if len(i):
                di, dt, place = doc_index(i, t)
                d, s, e = merge_spans(place, s, e)
                spans.append((di[d], dt[d], s, e))
        if spans:
            yield from span_blocks(*(np.concatenate(x) for x in zip(*spans, strict=True)), keys)

    yield from in_batches(rows())


def spans_by_document(batches):
    """Each block of documents of the part with its documents' merged spans: (block, {place: (s, e)})."""
    found, other = blocks_of(batches, DOCS, SPANS)
    for _ in other:
        raise ValueError("only documents and spans were expected")
    by = {}
    if s := joined(found[SPANS]):
        di, dt, place = doc_index(s["id"], s["th"])
        d, a, b = merge_spans(place, s["s"].astype(np.int64), s["e"].astype(np.int64))
        first = common.runs(d)
        for x, y in common.pieces(first, len(d)):
            by[int(di[d[x]]), int(dt[d[x]])] = (a[x:y], b[x:y])
    while found[DOCS]:
        block = found[DOCS].pop()
        yield block, [by.get((int(i), int(t))) for i, t in zip(block["id"], block["th"], strict=True)]


def kept_bytes(text: bytes, spans) -> bytes:
    if spans is None:
        return text
    s, e = spans
    return b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))


def dealt_spans(docs: DataFrame, keep: list[str], length: int, hot: dict) -> tuple[DataFrame, int]:
    """Blocks of documents and of their spans, meeting in the documents' parts."""
    spark = docs.sparkSession
    common.prepare(spark)
    n = common.parts(spark, 1)
    keys = common.dealt_keys(n)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    narrow = docs.select("doc_id", "text")
    often = hot_marks(narrow, length, n, **hot)
    marks = narrow.mapInArrow(common.tidied(lambda b: mark_blocks(b, length, keys, often)), BLOCK).repartition(n, "part")
    sites = marks.mapInArrow(common.tidied(lambda b: site_blocks(b, keys)), BLOCK)
    bodies = narrow.mapInArrow(common.tidied(lambda b: doc_blocks(b, keys, ["text"])), BLOCK)
    windows = sites.unionAll(bodies).repartition(n, "part").mapInArrow(common.tidied(lambda b: window_blocks(b, length, keys)), BLOCK)
    spans = windows.repartition(n, "part").mapInArrow(common.tidied(lambda b: repeat_blocks(b, length, keys)), BLOCK)
    whole = docs.mapInArrow(common.tidied(lambda b: doc_blocks(b, keys, keep)), BLOCK)
    return spans.unionAll(whole).repartition(n, "part")


def removal(docs: DataFrame, length: int = 100, **hot) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null and empty texts have no byte; texts shorter than `length` lose none; very long ones are handled whole.
    Rows with the same id and text are one document and get the same result; rows with one id and different
    texts are ordered by a hash of the text; a null id comes first. An empty table gives no row. Only doc_id and text
    are read. hot: how hot marks are found (see hot_marks); it changes no result.
    """

    def run(batches):
        for block, spans in spans_by_document(batches):
            table = opened(block)
            rows = []
            for text, x in zip(table.column("text").to_pylist(), spans, strict=True):
                b = text.encode()
                kept = kept_bytes(b, x)
                rows.append((len(b), len(b) - len(kept), 0 if x is None else len(x[0]), hashlib.sha256(kept).hexdigest()))
            n, removed, runs, sha = zip(*rows, strict=True)
            ids = table.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [ids if isinstance(ids, pa.Array) else ids.chunk(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    blocks = dealt_spans(docs.select("doc_id", "text"), ["doc_id", "text"], length, hot)
    schema = docs.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    return blocks.mapInArrow(common.tidied(run), schema)


def without_repeats(docs: DataFrame, length: int = 100, **hot) -> DataFrame:
    """The documents with repeated passages cut out of text (and n_chars, where there, counted anew).

    A character that lost only some of its bytes goes as a whole. Documents of which nothing is left are dropped. Null
    texts become empty and stay.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for block, spans in spans_by_document(batches):
            table = opened(block)
            old = table.column("text").to_pylist()
            new = [t if x is None else kept_bytes(t.encode(), x).decode("utf-8", "ignore") for t, x in zip(old, spans, strict=True)]
            keep = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if b.strip() or not a]
            if not keep:
                continue
            table = table.take(pa.array(keep)).combine_chunks()
            columns = {c: table.column(c) for c in names}
            columns["text"] = pa.array([new[i] for i in keep])
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(new[i]) for i in keep]).cast(columns["n_chars"].type)
            yield from pa.table(columns).combine_chunks().to_batches()

    return dealt_spans(docs, names, length, hot).mapInArrow(common.tidied(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8_suffix_dedup over the whole documents table."""
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
