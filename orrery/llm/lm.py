"""Operator 10: scoring texts by a word count model and by a causal self-attention model.

Words are looked up, not shipped: a task numbers the words of its documents as it meets them and asks, word by
word, the part that owns the word. There the counts of all tasks meet; the owner answers with the word's count in
the training documents and its subword ids. So a common word costs one row a task, and no table of all words
exists anywhere. Documents travel as word numbers, once.

The probability of a word is built in three layers, each a distribution over words:

* attention: the product of its subword ids' probabilities under the self-attention model, given that a word
  begins, times the probability that it ends there;
* that, mixed with the word's share of the training tokens;
* absolute discounting over the two words before: counts of the same three words in the training documents, less
  a discount, what is discounted going to the layer below. The discount follows from how many triples occur once
  and twice. A passage seen once therefore gains little, one seen again much.

All counts (words, ids, triples) cover all training documents. Triples meet like words do, as hashes: SLACK bits
longer than the number of tokens needs, so that a context is mistaken for another about once in 2 ** SLACK, at
every size. The model's weights are fitted to every id of every training document, segment by segment, by two rounds: each
task trains on its own documents from the common weights, and the tasks' weights are averaged by their steps, in two
levels. (A caller may ask for one segment in `every`; the query does not.) So what is learned grows with the corpus, and no task with it.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, bpe, common, sstable

WORDS, DOCS, ANSWERS, COUNTS, FOUND = 0, 1, 2, 3, 4
BLOCK = "part long, kind int, block binary"
#: Weight of the attention model against the word's share, below the triples.
ATTENTION_SHARE = 0.75
SEGMENT, LEAD, EVERY, WORD_BITS, SLACK = 512, 64, 1, 20, 12
#: Words after which a task trains on what it holds.
FLUSH = 400_000
WORD_BEGIN = re.compile(rb"[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])")
#: Stand for what is before a document and for its end.
START, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0676A9A99)


def numbered(column) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text with A-Z in lower case: how many, their numbers one after another, and the distinct words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))  # parts at runs of \x20 and \x09-\x0D
    flat, offsets = parts.flatten(), np.asarray(parts.offsets)
    real = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty part
    told = flat.filter(real).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(np.asarray(real))])
    return np.diff(before[offsets]), np.asarray(told.indices).astype(np.int64), told.dictionary.cast(pa.large_binary()).to_pylist()


def ask_blocks(batches, keys: np.ndarray, batch_bytes: int):
    """A task's documents as word numbers, and its distinct words with their counts in training documents."""
    from pyspark import TaskContext

    part, serial = TaskContext.get().partitionId(), 0
    docs, size = [], 0

    def flush():
        key = part * 1_000_000 + serial
        text = pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in docs])
        lengths, flat, words = numbered(text)
        held, id_ = (pa.concat_arrays([b.column(c) for b in docs]) for c in ("held_out", "doc_id"))
        out = np.asarray(held)
        train = np.bincount(flat[np.repeat(~out, lengths)], minlength=len(words)).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        owner = (hashes % np.uint64(len(keys))).astype(np.int64)
        yield key, DOCS, common.pack(key=key, doc_id=np.asarray(id_.fill_null(0)), null=np.asarray(id_.is_null()), held=out, n_words=lengths, words=planes(flat, 4), hashes=planes(hashes >> np.uint64(24), 5))
        order = np.argsort(owner, kind="stable")
        for a, b in common.pieces(common.runs(owner[order]), len(order)):
            at = order[a:b]
            yield int(keys[owner[at[0]]]), WORDS, common.pack(key=key, number=at.astype(np.uint32), count=train[at], words=b"\n".join([words[i] for i in at.tolist()]))

    for batch in common.slices(batches, 4 << 20):
        docs.append(batch)
        size += batch.column("text").nbytes
        if size >= batch_bytes:
            yield as_batch(flush())
            docs, size, serial = [], 0, serial + 1
    if docs:
        yield as_batch(flush())


def as_batch(rows):
    rows = list(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["part", "kind", "block"],
    )


def planes(x: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of each number, byte by byte: what is zero or alike then packs well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def from_planes(p: np.ndarray) -> np.ndarray:
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, : len(p)] = p.T
    return out.view("<u8").ravel()


def answer_blocks(batches, tokenizer: str):
    """All counts of the words of one part together: answers to each batch, and the part's share of corpus counts."""
    blocks = [common.unpack(x.as_buffer()) for batch in batches for x in batch.column("block")]
    if not blocks:
        return
    place, total, lists = {}, [], []
    for b in blocks:
        words = b["words"].split(b"\n")
        at = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
        lists.append(at)
    total = np.zeros(len(place), np.int64)
    for at, b in zip(lists, blocks, strict=True):
        np.add.at(total, at, b["count"])
    enc = sstable.encoder(tokenizer)
    words = [*place]
    subs = [enc.words([w.decode() for w in words[a : a + 50_000]]) for a in range(0, len(words), 50_000)]
    flat, length = (np.concatenate(x) for x in zip(*subs, strict=True))
    begin = np.cumsum(length) - length
    uses = np.bincount(flat, np.repeat(total, length).astype(np.float64), minlength=enc.size)
    used = np.flatnonzero(uses)
    yield as_batch([(0, COUNTS, common.pack(id=np.append(used, [-1, -2]), uses=np.append(uses[used].astype(np.int64), [int(total.sum()), int((total > 0).sum())])))])
    for at, b in zip(lists, blocks, strict=True):
        yield as_batch([(b["key"], ANSWERS, common.pack(number=b["number"], count=total[at], length=length[at].astype(np.uint16 if not len(length) or length.max() < 65536 else np.uint32), ids=flat[common.ranges(begin[at], length[at])]))])


def count_rows(batches):
    """COUNTS blocks as (id, uses); -1: words in all, -2: distinct words, -3 and -4: triples that occur once and twice."""
    for batch in batches:
        for x in batch.column("block"):
            b = common.unpack(x.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(b["id"].astype(np.int64)), pa.array(b["uses"].astype(np.int64))], ["id", "uses"])


def triples(d: dict, parts: int, bits: int):
    """(part, key) of every token of a block's documents, ends included, in order. A key is the hash of the two words
    before, as far as the part does not tell it, over WORD_BITS of the word's own."""
    hashes = from_planes(d["hashes"])
    n = d["n_words"]
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(int((n + 1).sum()), bool)
    inner[ends] = False
    word = np.full(len(inner), END, np.uint64)
    word[inner] = hashes[from_planes(d["words"])]
    context = np.empty_like(word)  # the word before, then with the one before that
    context[1:] = word[:-1]
    context[ends[:-1] + 1] = START
    context[:1] = START
    two = np.empty_like(word)
    two[1:] = context[:-1]
    two[ends[:-1] + 1] = START
    two[:1] = START
    context *= np.uint64(0xD1342543DE82EF95)
    context += common.mix64(two)
    del two
    context = common.mix64(context)
    context >>= np.uint64(64 - bits)
    part = (context % np.uint64(parts)).astype(np.int32)
    context //= np.uint64(parts)
    context <<= np.uint64(WORD_BITS)
    word = common.mix64(word)
    word >>= np.uint64(64 - WORD_BITS)
    context |= word
    return part, context


def triple_blocks(batches, keys: np.ndarray, bits: int):
    """Distinct triples of each block of documents, with their counts in its training documents, for their owners."""
    for batch in batches:
        for block in batch.column("block"):
            d = common.unpack(block.as_buffer())
            part, key = triples(d, len(keys), bits)
            train = np.repeat(~d["held"], d["n_words"] + 1)
            both = key << np.uint64(1) | train.astype(np.uint64)
            order = np.argsort(part, kind="stable")
            rows = []
            for a, b in common.pieces(common.runs(part[order]), len(order)):
                x = np.sort(both[order[a:b]])
                k = x >> np.uint64(1)
                first = common.runs(k)
                count = np.add.reduceat((x & np.uint64(1)).astype(np.int64), first)
                steps = np.diff(k[first], prepend=np.uint64(0))
                p = int(part[order[a]])
                rows.append((int(keys[p]), FOUND, common.pack(key=d["key"], owner=p, steps=planes(steps, 8), count=planes(count, 4))))
            yield as_batch(rows)


def found_blocks(batches):
    """Triples of one part together. To each block: count of the triple, count and kinds of its context's."""
    blocks = [common.unpack(x.as_buffer()) for batch in batches for x in batch.column("block")]
    if not blocks:
        return
    size = np.array([b["count"].shape[1] for b in blocks], np.int64)
    key = np.concatenate([np.cumsum(from_planes(b.pop("steps")), dtype=np.uint64) for b in blocks])
    count = np.concatenate([from_planes(b.pop("count")) for b in blocks]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = common.runs(key)
    total = np.add.reduceat(count[order], first)
    context = key[first] >> np.uint64(WORD_BITS)
    group = common.runs(context)
    width = np.diff(np.append(group, len(context)))
    all_ = np.repeat(np.add.reduceat(total, group), width)
    kinds = np.repeat(np.add.reduceat((total > 0).astype(np.int64), group), width)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    yield as_batch([(0, COUNTS, common.pack(id=np.array([-3, -4]), uses=np.array([int((total == 1).sum()), int((total == 2).sum())])))])
    ends = np.cumsum(size)
    for b, e, n in zip(blocks, ends.tolist(), size.tolist(), strict=True):
        at = back[e - n : e]
        yield as_batch([(b["key"], FOUND, common.pack(owner=b["owner"], triple=planes(total[at], 4), context=planes(all_[at], 4), kinds=planes(kinds[at], 4)))])


def cuts(text: bytes, turn: int, chosen: range, of: int):
    """Where the segments of a text that are due begin and end: one in `of`, in rotation from `turn`. A segment begins
    with the first word that begins SEGMENT bytes, or a multiple, into the text; the others are not looked at."""
    n = max(1, -(-len(text) // SEGMENT))
    for k in range(n):
        if (k + turn) % of in chosen:
            a, b = (edge(text, x * SEGMENT) for x in (k, k + 1))
            if n == 1 or text[a:b].strip():
                yield a, b


def segments(text: bytes, turn: int, chosen: range, of: int):
    """(words, first, last) of the segments that are due."""
    for a, b in cuts(text, turn, chosen, of):
        yield text[a:b].split(), a == 0, b == len(text)


def led(text: bytes, turn: int, chosen: range, of: int):
    """(words, how many of them are context alone, last) of the segments that are due: the words that begin in the LEAD
    bytes before a segment go ahead of it, so that its own words are all asked for, in their context."""
    for a, b in cuts(text, turn, chosen, of):
        before = text[edge(text, a - LEAD) : a].split() if a else []
        yield before + text[a:b].split(), len(before), b == len(text)


def edge(text: bytes, at: int) -> int:
    """Where the first word that begins at `at` or behind it begins, or the text's end."""
    if not 0 < at < len(text):
        return min(max(at, 0), len(text))
    m = WORD_BEGIN.search(text, at - 1)
    return m.end() if m else len(text)


class TaskWords:
    """The words a task has met and their subword ids. A word that recurs is not encoded again, however many streams
    were made in between, until more than `most` are remembered."""

    def __init__(self, enc, end: int, most: int = 250_000):
        self.enc, self.end, self.most = enc, end, most
        self.forget()

    def forget(self) -> None:
        # no word is empty: this one stands for the end of a document
        self.number, self.ids, self.size = {b"": 0}, np.array([self.end], np.uint32), np.ones(1, np.int64)

    def numbers(self, words: list[bytes], ended: bool) -> list[int]:
        number = self.number
        return [number.setdefault(w, len(number)) for w in words] + [0] * ended

    def streams(self, held: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (numbers, how many of them are context alone): the ids one after another, how many each has, and how many of
        these are context. Numbers given before hold no longer if too many words are remembered."""
        ids, size = self.enc.words([w.decode() for w in itertools.islice(self.number, len(self.size), None)])
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        words = np.fromiter(itertools.chain.from_iterable(x for x, _ in held), np.int64)
        ends = np.cumsum([len(x) for x, _ in held])
        first = ends - [len(x) for x, _ in held]
        begin, size = np.cumsum(self.size) - self.size, self.size[words]
        before = np.append(0, np.cumsum(size))
        out = self.ids[common.ranges(begin[words], size)].astype(np.int64)
        silent = before[first + [lead for _, lead in held]] - before[first]
        if len(self.number) > self.most:
            self.forget()
        return out, before[ends] - before[first], silent


def train_model(batches, tokenizer: str, counts: np.ndarray, weights: dict | None, chosen, of: int):
    """One task's training: from the common weights, over the due segments of its documents. A row: weights, steps."""
    from pyspark import TaskContext

    enc, end = sstable.encoder(tokenizer), len(counts) - 1
    vocabulary = attention.Vocabulary(counts, np.append(enc.opens, True))
    model = attention.Model(vocabulary)
    if weights is not None:
        model.w = {k: v.copy() for k, v in weights.items()}
    trainer = attention.Trainer(model)
    known, held = TaskWords(enc, end), []

    def flush():
        ids, lengths, silent = known.streams(held)
        cur, opens, into = attention.blocks(vocabulary.input_of[ids], lengths, int(vocabulary.input_of[end]))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        target = np.full(cur.size, -1, np.int64)
        target[into] = np.where(place < np.repeat(silent, lengths), -1, ids)
        target = target.reshape(cur.shape)
        due = np.flatnonzero((target >= 0).any(1))
        trainer.take(cur[due], attention.previous(cur)[due], opens[due], target[due])

    words_in = 0
    for batch in common.slices(batches, 4 << 20):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            turn = int(common.mix64(np.array([doc_id or 0]).view(np.uint64))[0] >> np.uint64(40))
            for words, lead, last in led(text.encode().lower(), turn, chosen, of):
                held.append((known.numbers(words, last), lead))
                words_in += len(words)
        if words_in >= FLUSH:
            flush()
            held, words_in = [], 0
    if held:
        flush()
    if trainer.t:
        yield model_row(TaskContext.get().partitionId(), trainer.t, model.w)


def model_row(group: int, steps: int, weights: dict):
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([steps], pa.int64()), pa.array([common.pack(**weights)], pa.binary())], ["g", "steps", "model"])


def averaged(batches):
    """One row: the mean of the task's models by their steps."""
    total, steps, group = {}, 0, 0
    for batch in batches:
        for g, n, x in zip(batch.column("g").to_pylist(), batch.column("steps").to_pylist(), batch.column("model"), strict=True):
            group, steps = g, steps + n
            for k, v in common.unpack(x.as_buffer()).items():
                total[k] = total.get(k, 0) + v.astype(np.float64) * n
    if steps:
        yield model_row(group, steps, {k: (v / steps).astype(np.float32) for k, v in total.items()})


def trained(src: DataFrame, tokenizer: str, counts: np.ndarray, every: int = EVERY) -> dict | None:
    """Weights after two rounds over src (doc_id, held_out, text): a quarter of the due segments, then the rest."""
    of, kind, weights = every * 4, "g int, steps long, model binary", None
    rows = src.filter(~F.col("held_out")).select("doc_id", "text")
    some = math.isqrt(common.parts(src.sparkSession, 1)) + 1
    for chosen in (range(1), range(1, 4)):
        models = rows.mapInArrow(common.tidied(lambda b, w=weights, c=chosen: train_model(b, tokenizer, counts, w, c, of)), kind)
        for groups in (some, 1):
            models = models.repartition(groups, F.pmod("g", F.lit(groups))).sortWithinPartitions("g").mapInArrow(common.tidied(averaged), kind)
        row = models.first()
        if row is not None:
            weights = common.unpack(row.model)
    return weights


def score_blocks(batches, facts: dict, counts: np.ndarray, opens: np.ndarray, weights: dict | None):
    """Scores of each batch of documents whose answers are at hand."""
    model = attention.Model(attention.Vocabulary(counts, opens))
    if weights is not None:
        model.w = weights
    for batch in batches:
        for docs, answers, found in zip(batch.column("docs"), batch.column("answers"), batch.column("found"), strict=True):
            yield scored(common.unpack(docs.as_buffer()), [common.unpack(x.as_buffer()) for x in answers], [common.unpack(x.as_buffer()) for x in found], facts, model, len(counts) - 1)


def seen_before(d: dict, found: list[dict], facts: dict):
    """For every token: count of its triple, count and kinds of its context's triples, in the training documents."""
    part, key = triples(d, facts["parts"], facts["bits"])
    out = np.zeros((3, len(key)), np.uint32)
    order = np.argsort(part, kind="stable")
    by = {b["owner"]: b for b in found}
    for a, b in common.pieces(common.runs(part[order]), len(order)):
        at = order[a:b]
        x = by.pop(int(part[at[0]]))
        # each key's place among the distinct ones
        along = np.argsort(key[at])
        first = np.zeros(len(at), np.int64)
        first[common.runs(key[at][along])] = 1
        place = np.empty(len(at), np.int64)
        place[along] = np.cumsum(first) - 1
        for i, name in enumerate(("triple", "context", "kinds")):
            out[i, at] = from_planes(x[name])[place]
    return out


def scored(d: dict, answers: list[dict], found: list[dict], facts: dict, model: attention.Model, end: int):
    distinct = d["hashes"].shape[1]
    count, length, begin, at = np.zeros(distinct, np.int64), np.zeros(distinct, np.int64), np.zeros(distinct, np.int64), 0
    for a in answers:
        n = a["length"].astype(np.int64)
        count[a["number"]], length[a["number"]], begin[a["number"]] = a["count"], n, at + np.cumsum(n) - n
        at += int(n.sum())
    flat = np.concatenate([a["ids"] for a in answers]) if answers else np.zeros(0, np.uint32)
    words, n_words, n = from_planes(d["words"]).astype(np.int64), d["n_words"], len(d["n_words"])
    doc = np.repeat(np.arange(n), n_words)
    known = np.bincount(doc, count[words] > 0, n).astype(np.int64) + int(facts["docs"] > 0)
    logs = np.bincount(doc, np.log10(count[words] + 1.0), n) + np.log10(facts["docs"] + 1.0)
    base = logs - (n_words + 1) * np.log10(float(facts["n"] + facts["v"] + 1))
    triple, context, kinds = seen_before(d, found, facts)
    found.clear()
    score = np.empty(n)
    bounds = np.append(np.cumsum(n_words) - n_words, len(words))
    a = 0
    while a < n:  # about a hundred thousand words at a time
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 100_000, "right")) - 1)
        w = words[bounds[a] : bounds[b]]
        size = length[w]
        # one end behind each document
        per = np.bincount(doc[bounds[a] : bounds[b]] - a, size, b - a).astype(np.int64) + 1
        ids = np.full(int(per.sum()), end, np.int64)
        ends = np.cumsum(per) - 1
        inner = np.ones(len(ids), bool)
        inner[ends] = False
        ids[inner] = flat[common.ranges(begin[w], size)]
        cur, opens, into = attention.blocks(model.v.input_of[ids], per, int(model.v.input_of[end]))
        target = np.full(cur.size, -1, np.int64)
        target[into] = ids
        logp, opening = (x.ravel()[into].astype(np.float64) for x in model.log_probabilities(cur, opens, target.reshape(cur.shape)))
        # tokens: words, and an end behind each document
        tokens = n_words[a:b] + 1
        last = np.cumsum(tokens) - 1
        is_word = np.ones(int(tokens.sum()), bool)
        is_word[last] = False
        width = np.ones(len(is_word), np.int64)
        width[is_word] = size
        first = np.cumsum(width) - width
        by = np.add.reduceat(logp, first) - opening[first]
        by[is_word] += opening[(first + width)[is_word]]
        uses = np.full(len(is_word), facts["docs"], np.float64)
        uses[is_word] = count[w]
        here = slice(bounds[a] + a, bounds[b] + b)
        seen = (x[here].astype(np.float64) for x in (triple, context, kinds))
        logs = word_logs(by, uses / max(facts["n"], 1), *seen, facts["discount"])
        score[a:b] = np.add.reduceat(logs, np.append(0, last[:-1] + 1)) / np.log(10.0)
        a = b
    return pa.RecordBatch.from_arrays(
        [pa.array(d["doc_id"], mask=d["null"]), pa.array(d["held"]), pa.array(n_words + 1), pa.array(known),
         pa.array(np.full(n, facts["n"], np.int64)), pa.array(base), pa.array(score)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def word_logs(attended: np.ndarray, share: np.ndarray, triple: np.ndarray, context: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
    """Natural log of each token's probability: the attention model's, its share of the training tokens, and the
    discounted counts of its triple and context."""
    with np.errstate(divide="ignore"):
        low = np.logaddexp(np.log(ATTENTION_SHARE) + attended, np.log((1 - ATTENTION_SHARE) * share))
        all_ = np.maximum(context, 1)
        high = np.logaddexp(np.log(np.maximum(triple - discount, 0) / all_), np.log(discount * kinds / all_) + low)
    return np.where(context > 0, high, low)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def summed(blocks: DataFrame) -> dict:
    """COUNTS over all parts: at most one row for each id of the vocabulary."""
    rows = blocks.filter(F.col("kind") == COUNTS).mapInArrow(common.tidied(count_rows), "id long, uses long").groupBy("id").agg(F.sum("uses").alias("uses"))
    return {r.id: r.uses for r in rows.collect()}


def gathered(blocks: DataFrame, kind: int, name: str) -> DataFrame:
    return blocks.filter(F.col("kind") == kind).groupBy("part").agg(F.collect_list("block").alias(name))


def language_model(docs: DataFrame, tokenizer: str, divisor: int = 7, every: int = EVERY, batch_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Held out are rows whose crc32(doc_id as text) mod divisor is 2; a null doc_id is not. A null or empty text is
    its end token alone. Very long texts are scored whole, in windows; repeated rows each get the same scores. An
    empty table gives no row. Without training documents all counts are 0 and the model keeps its first weights.
    Only doc_id and text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    n = common.parts(spark, 1)
    keys = common.dealt_keys(n)
    src = common.texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", common.held_out("doc_id", divisor))
    path = common.shared_dir(spark, "lm-words")
    src.mapInArrow(common.tidied(lambda b: ask_blocks(b, keys, batch_bytes)), BLOCK).write.partitionBy("kind").parquet(path)
    all_blocks = spark.read.schema("part long, block binary, kind int").parquet(path).select("part", "kind", "block")
    own = lambda df: df.withColumn("part", F.col("part").cast("int")).repartition(n, "part")
    answered = common.cut(own(all_blocks.filter(F.col("kind") == WORDS)).mapInArrow(common.tidied(lambda b: answer_blocks(b, tokenizer)), BLOCK), "lm-answers")
    uses = summed(answered)
    n_train = src.filter(~F.col("held_out")).count()
    enc = sstable.encoder(tokenizer)
    counts, opens = np.zeros(enc.size + 1, np.int64), np.append(enc.opens, True)
    for i, c in uses.items():
        if i >= 0:
            counts[i] = c
    counts[enc.size] = n_train
    tokens = uses.get(-1, 0) + n_train
    bits = min(math.ceil(math.log2(tokens + 2)) + SLACK, 63 - WORD_BITS + int(math.log2(n)))
    texts = all_blocks.filter(F.col("kind") == DOCS)
    asked = own(texts.select("block").mapInArrow(common.tidied(lambda b: triple_blocks(b, keys, bits)), BLOCK))
    found = common.cut(asked.mapInArrow(common.tidied(found_blocks), BLOCK), "lm-triples")
    rare = summed(found)
    once, twice = rare.get(-3, 0), rare.get(-4, 0)
    facts = {"docs": n_train, "n": tokens, "v": uses.get(-2, 0) + int(n_train > 0), "parts": n, "bits": bits,
             "discount": once / (once + 2 * twice) if once else 0.5}
    weights = trained(src, tokenizer, counts, every)
    met = texts.select("part", F.col("block").alias("docs")).join(gathered(answered, ANSWERS, "answers"), "part", "left").join(gathered(found, FOUND, "found"), "part", "left")
    none = F.array().cast("array<binary>")
    met = met.select("docs", F.coalesce("answers", none).alias("answers"), F.coalesce("found", none).alias("found"))
    return met.mapInArrow(common.tidied(lambda b: score_blocks(b, facts, counts, opens, weights)), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op10_attention_lm over the whole documents table."""
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_tokenizer())
