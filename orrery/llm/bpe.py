"""Operator 7: byte-level BPE encoding and decoding by forced-boundary splitting.

A pre-token is cut between two bytes whenever that pair occurs inside no vocabulary entry: no merge
can ever join them, so the fragments are encoded one by one and their ids concatenated. Fragments
recur, so each is merged once and remembered in a bounded table.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The published pre-token pattern of this kind of tokenizer. White space is spelled out,
#: as regex engines differ in what \s covers.
_SP = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SP}\p{{L}}\p{{N}}]+|[{_SP}]+(?![^{_SP}])|[{_SP}]+"
)
#: Blocks whose letters, digits and signs have stood since Unicode 6 at the latest, so that every version in
#: use agrees on them. Latin, Greek, Cyrillic, Hebrew and Arabic letters, Devanagari and Thai letters, punctuation,
#: currency, arrows, operators, box drawing, CJK signs, kana, CJK, Hangul, full-width forms, pictographs.
SETTLED = regex.compile(
    r"[\u0000-\u001b\u0020-\u0084\u0086-\u009f\u00a1-\u024f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03ce\u0400-\u0481"
    r"\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0660-\u0669\u0904-\u0939\u0966-\u096f\u0e01-\u0e30\u0e40-\u0e45\u1e00-\u1eff"
    r"\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u2200-\u22ff\u2500-\u257f\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa"
    r"\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f320\U0001f400-\U0001f43e]*"
)
#: What is or was white space to some version, and what is near it.
WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
ODD_WHITE = regex.compile(rf"[{WHITE}--[ \n]]", regex.V1)
#: A space that stands alone: whatever is before it, a pre-token ends there and one begins with it.
ALONE = regex.compile(rf"(?<=[^{WHITE}])(?= [^{WHITE}])")


def default_tokenizer() -> str:
    """The path is a parameter everywhere; this is only where the queries find the public file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """A bounded table in two generations: what was used since the last change of generation is kept."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}  # plain dicts: set operations are quick with them

    def missing(self, tokens) -> set:
        """Those without an entry, after entries of the old generation were taken over."""
        if len(self.now) >= self.most:
            self.now, self.old = {}, self.now
        new = set(tokens).difference(self.now)
        if self.old and new:
            old = self.old
            back = [t for t in new if t in old]
            self.now.update((t, old[t]) for t in back)
            new.difference_update(back)
        return new


#: Where white space does not stand alone between words: such texts are split by the full pattern.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\v", "\f", "\r", "\0")


def settled(text: str) -> bool:
    return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or bool(SETTLED.fullmatch(text))


def even(text: str) -> bool:
    if any(u in text for u in UNEVEN) or text[:1] == "\n" or text[-1:] in ("\n", " "):
        return False
    return not ODD_WHITE.search(text)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; of one with unsettled characters, those between spaces that stand alone, and what
    holds such characters as a whole, for the library to split."""
    if settled(text):
        return PRETOKEN.findall(text)
    return [t for piece in ALONE.split(text) for t in (PRETOKEN.findall(piece) if settled(piece) else [piece])]


class ByWords:
    """Ids of texts by way of their words, most of which recur.

    Where every white space stands alone, a pre-token never reaches across the place in front of it. So a word
    with the space or line break in front of it has the same ids wherever it stands, and they are remembered: a
    word under itself, behind \\n if a line break is in front of it, behind \\0 if nothing is. `learn` gives the ids of
    a set of pre-tokens, or of pieces with unsettled characters; `learn_words` those of a list of words of settled
    letters, each with a space in front.
    """

    def __init__(self, learn, learn_words, remembered: int = 250_000):
        self.learn, self.learn_words, self.words, self.marks = learn, learn_words, Recent(remembered), {}

    @staticmethod
    def split(word: str) -> list[str]:
        text = word.lstrip("\0") if word[0] in "\0\n" else " " + word
        return PRETOKEN.findall(text) if settled(text) else [text]

    def ids(self, words: list[str]) -> list[bytes]:
        """uint32 ids of each word (as kept, see above), as bytes."""
        new = self.words.missing(words)
        known = self.words.now
        if new:
            letters = [w for w in new if w.isalpha() and settled(w)]
            rest = new.difference(letters)
            # a word with a mark behind it: the mark is a pre-token of its own
            marked = [w for w in rest if w[-1] in ".,|" and w[:-1].isalpha() and settled(w)]
            rest.difference_update(marked)
            letters += {w[:-1] for w in marked}.difference(known, letters)
            if letters:
                known.update(zip(letters, self.learn_words(letters), strict=True))
            if not self.marks:
                self.marks = self.learn(set(".,|"))
            for w in marked:
                known[w] = known[w[:-1]] + self.marks[w[-1]]
            if rest:
                split = {w: self.split(w) for w in rest}
                of = self.learn(set(itertools.chain.from_iterable(split.values()))).__getitem__
                for w, ts in split.items():
                    known[w] = b"".join(map(of, ts))
        out = [*map(known.__getitem__, words)]
        for w in new:
            if len(w) > 256:  # such words hardly recur
                known.pop(w, None)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text. The many short-lived lists hold no cycles: the collector only costs time here."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Words are told apart in Arrow, so only distinct ones are looked up."""
        regular = [i for i, t in enumerate(texts) if even(t)]
        out: list = [None] * len(texts)
        if regular:
            column = pa.array([texts[i] for i in regular], pa.large_string())
            column = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), column, pa.scalar("", pa.large_string()))
            parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
            told = parts.flatten().dictionary_encode()
            index = told.indices.to_numpy()
            kept = self.ids(told.dictionary.to_pylist())
            pool = np.frombuffer(b"".join(kept), "<u4")
            size = np.fromiter(map(len, kept), np.int64, len(kept)) >> 2
            begin = np.cumsum(size) - size
            size = size[index]
            flat = pool[common.ranges(begin[index], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[np.asarray(parts.offsets)]
            for k, i in enumerate(regular):
                out[i] = flat[ends[k] : ends[k + 1]]
        for i, t in enumerate(texts):
            if out[i] is None:
                tokens = pretokens(t)
                out[i] = np.frombuffer(b"".join(map(self.learn(set(tokens)).__getitem__, tokens)), "<u4")
        return out


class ForcedBoundaryBPE:
    """Encoder and decoder over a tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str, remembered: int = 100_000):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.vocab = vocab
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.rank, self.made = {}, []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault(vocab[a] << 32 | vocab[b], k)
            self.made.append(vocab[a + b])
        joined = np.zeros((256, 256), bool)
        for t in vocab:
            for a, b in zip(t, t[1:], strict=False):
                joined[a, b] = True
        self.joined, self.inside = joined, set(zip(*(x.tolist() for x in np.nonzero(joined)), strict=True))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.decimal = {i: b"%d" % i for i in self.bytes_of}
        self.remembered, self.fragments, self.by_words = remembered, {}, ByWords(self._learn, self._learn_words, remembered)

    def cuts(self, token: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        if self.inside.issuperset(zip(token, token[1:], strict=False)):
            return [token]
        b = np.frombuffer(token, np.uint8)
        at = np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1
        ends = [0, *at.tolist(), len(token)]
        return [token[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def merged(self, fragment: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until no pair has a rank."""
        ids = [*map(self.first.__getitem__, fragment)]
        if len(ids) > 512:
            return self._merged_long(ids)
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap over a linked list, for fragments of any length."""
        import heapq

        n = len(ids)
        after, before, rank = [*range(1, n), -1], [*range(-1, n - 1)], self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := rank(ids[left] << 32 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]

    def _pretoken(self, token: str) -> bytes:
        """uint32 ids of a pre-token as bytes."""
        pieces, known = self.cuts(token.encode()), self.fragments
        if len(pieces) == 1:
            return np.array(self.merged(pieces[0]), "<u4").tobytes()
        out = []
        for fragment in pieces:
            ids = known.get(fragment)
            if ids is None:
                if len(known) >= self.remembered:
                    known.clear()
                ids = self.merged(fragment)
                if len(fragment) <= 64:
                    known[fragment] = ids
            out += ids
        return np.array(out, "<u4").tobytes()

    def forget(self) -> None:
        """Drop what was remembered: a worker that outlives its task should not hold on to it."""
        self.fragments, self.by_words = {}, ByWords(self._learn, self._learn_words, self.remembered)

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        known = {t: self._pretoken(t) for t in new if settled(t)}
        if rest := [t for t in new if t not in known]:
            known.update(zip(rest, self._by_library(rest), strict=True))
        return known

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        """The library's own answer for pieces whose characters may differ in class between Unicode versions."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        return [self._pretoken(" " + w) for w in words]

    def _ordinary(self, text: str) -> np.ndarray:
        return self.by_words.encode([text])[0]

    def encode(self, text: str) -> np.ndarray:
        """Token ids; an added token's string in the text becomes its id, as the library does."""
        if self.splitter is None or not any(a in text for a in self.added):
            return self._ordinary(text)
        pieces = [np.array([self.added[x]], "<u4") if x in self.added else self._ordinary(x) for x in self.splitter.split(text) if x]
        return np.concatenate([np.zeros(0, "<u4"), *pieces])

    def decode(self, ids) -> str:
        """The text of the ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker and file."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def encode_column(docs: DataFrame, tokenizer: str, *keys: str) -> DataFrame:
    """keys, token_ids array<int>, decoded string of every row; null text counts as empty.

    Rows stay where they are: nothing is shuffled, and memory is bounded by one slice of a batch.
    """
    common.prepare(docs.sparkSession)

    src = docs.select(*keys, F.coalesce("text", F.lit("")).alias("__text"))

    def run(batches):
        bpe = loaded(tokenizer)
        for batch in common.slices(batches, 4 << 20):
            ids = ids_of(bpe, batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))]
                + [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids])],
                [*keys, "token_ids", "decoded"],
            )
        bpe.forget()

    schema = src.drop("__text").schema.add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return src.mapInArrow(common.tidied(run), schema)


def ids_of(bpe: ForcedBoundaryBPE, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text; those with the string of an added token are split at it."""
    plain = [not any(a in t for a in bpe.added) for t in texts]
    done = iter(bpe.by_words.encode([t for t, ok in zip(texts, plain, strict=True) if ok]))
    return [next(done) if ok else bpe.encode(t) for t, ok in zip(texts, plain, strict=True)]


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, whether they decode to the text, and the row's place (shard, row) in the
    files of docs, of every row: ordered by place, the ids stand in the order in which docs were written.

    Null texts are empty and have no id; very long texts are encoded whole; rows that repeat each have their ids; an
    empty table gives no row. Only doc_id, source and text are read, so other columns may have any name.
    """
    placed = common.in_place(docs.select("doc_id", "source", "text"), "shard", "row")
    rows = encode_column(placed, tokenizer, "doc_id", "source", "text", "shard", "row")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"), "shard", "row")


def encode_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (null text: empty; repeated rows: each its own).

    Digests are taken where the ids are made, so that no id list leaves the worker.
    """
    common.prepare(docs.sparkSession)

    def run(batches):
        bpe = loaded(tokenizer)
        digit, of = bpe.decimal.__getitem__, bpe.bytes_of.__getitem__
        for batch in common.slices(batches, 6 << 20):
            n, ids_hash, text_hash = [], [], []
            for x in ids_of(bpe, batch.column("text").to_pylist()):
                ids = x.tolist()
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join(map(digit, ids))).hexdigest())
                back = b"".join(map(of, ids)).decode("utf-8", "replace").encode()
                text_hash.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    src = common.texts(docs, "doc_id")
    schema = src.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return src.mapInArrow(common.tidied(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7_bpe over the whole documents table."""
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())

