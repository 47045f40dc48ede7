"""Operator 6: token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*  index  filter  footer

* block: zstd over records `shared | rest | length | key rest | value`; a key gives only what differs
  from the key before it, and every RESTART-th record starts afresh; a crc32 of the packed bytes follows.
* index: one entry for each block: its last key, offset and packed size (sparse).
* filter: a Bloom filter over all keys, 10 bits a key, 7 probes.
* footer: fixed size; offsets and sizes of index and filter, counts of records and of token ids, magic.

A lookup asks the filter, finds the block by binary search in the index, and reads that block alone.
Values are little-endian unsigned ids, two bytes wide where the shard's vocabulary fits, else four.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

MAGIC = b"ORRYSST1"
RESTART = 16
FOOTER = struct.Struct("<QQQQQQB7x8s")
PROBES, BITS_A_KEY = 7, 10


def key_of(doc_id: int | None) -> bytes:
    """Keys sort as the ids do; a null id sorts first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class ShardWriter:
    """Collects records in ascending key order; finish() gives the shard's bytes."""

    def __init__(self, width: int, block_bytes: int = 256 << 10):
        self.width, self.block_bytes = width, block_bytes
        self.out, self.block, self.index, self.keys = bytearray(), bytearray(), [], []
        self.last, self.in_block, self.ids = b"", 0, 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        shared = 0 if self.in_block % RESTART == 0 else len(os.path.commonprefix([self.last, key]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.in_block, self.ids = key, self.in_block + 1, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if not self.in_block:
            return
        packed = self.packer.compress(bytes(self.block))
        self.index.append((self.last, len(self.out), len(packed)))
        self.out += packed + struct.pack("<I", zlib.crc32(packed))
        self.block, self.in_block = bytearray(), 0

    @property
    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close_block()
        index_at = len(self.out)
        for key, offset, size in self.index:
            self.out += varint(len(key)) + key + varint(offset) + varint(size)
        filter_at = len(self.out)
        bits = max(64, -(-BITS_A_KEY * len(self.keys) // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out += bloom
        self.out += FOOTER.pack(index_at, filter_at - index_at, filter_at, len(bloom), len(self.keys), self.ids, self.width, MAGIC)
        return bytes(self.out)


class ShardReader:
    """Opens a shard from bytes, or lazily from anything with seek and read."""

    def __init__(self, source):
        self.file = None if isinstance(source, bytes | memoryview) else source
        self.data = memoryview(source).cast("B") if self.file is None else None
        size = len(self.data) if self.file is None else self.file.seek(0, 2)
        foot = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError("not a shard")
        index_at, index_size, filter_at, filter_size, self.n_records, self.n_ids, self.width, _ = foot
        index, at, self.blocks = self._read(index_at, index_size), 0, []
        while at < index_size:
            n, at = read_varint(index, at)
            key, at = bytes(index[at : at + n]), at + n
            offset, at = read_varint(index, at)
            length, at = read_varint(index, at)
            self.blocks.append((key, offset, length))
        self.bloom = self._read(filter_at, filter_size)
        self.blocks_read = 0

    def _read(self, at: int, n: int):
        if self.file is None:
            return self.data[at : at + n]
        self.file.seek(at)
        return self.file.read(n)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, 8 * len(self.bloom)))

    def _block(self, k: int):
        _, offset, size = self.blocks[k]
        packed = bytes(self._read(offset, size))
        (crc,) = struct.unpack("<I", self._read(offset + size, 4))
        if zlib.crc32(packed) != crc:
            raise ValueError("damaged block")
        self.blocks_read += 1
        data, at, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            length, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", length // self.width, at)
            at += length

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """All values under the key (ids may repeat), reading no more blocks than hold it."""
        found = []
        if self.may_hold(key):
            k = bisect.bisect_left(self.blocks, key, key=lambda b: b[0])
            while k < len(self.blocks):
                for have, value in self._block(k):
                    if have == key:
                        found.append(value)
                    elif have > key:
                        return found
                k += 1
        return found


class LibraryEncoder:
    """The tokenizers library: asked for whole texts, or for words, of which it is asked once for each that recurs."""

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size, self.by_words = self.tok.get_vocab_size(), bpe.ByWords(self._learn, self._learn_words, remembered)
        self.marks: dict[str, int] = {}
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)])

    def whole_texts(self, texts: list[str]) -> list[np.ndarray]:
        """One call a text: what the library keeps of a token beside its id is many times the text, and is given back before
        the next call asks for it, while a batch would hold that of all texts at once."""
        return [np.array(e.ids, "<u4") for t in texts for e in self.tok.encode_batch_fast([t], add_special_tokens=False)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, by way of its words. What is new in all of them is asked for together."""
        plain = [not any(s in t for s in self.special) for t in texts]
        done = iter(self.by_words.encode([t for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(done) if ok else self.whole_texts([t])[0] for t, ok in zip(texts, plain, strict=True)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word behind a space, one after another, and how many each has."""
        kinds = np.array([self._kind(w) for w in words], np.int8)
        cuts = {k: np.flatnonzero(kinds == k) for k in (0, 1, 2)}
        flat, size, begin = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = 0
        for k in (0, 1):
            if len(cuts[k]):
                some = [words[i][:-1] if k else words[i] for i in cuts[k].tolist()]
                packed = self._learn_words(some)
                n = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
                size[cuts[k]], begin[cuts[k]] = n, at + np.cumsum(n) - n
                flat.append(np.frombuffer(b"".join(packed), "<u4"))
                at += int(n.sum())
        if len(cuts[2]):
            found = [e.ids for e in self.tok.encode_batch_fast([" " + words[i] for i in cuts[2].tolist()], add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            size[cuts[2]], begin[cuts[2]] = n, at + np.cumsum(n) - n
            flat.append(np.fromiter((x for f in found for x in f), "<u4", int(n.sum())))
        pool = np.concatenate([*flat, np.zeros(0, "<u4")])
        full = size + (kinds == 1)
        out = np.empty(int(full.sum()), "<u4")
        ends = np.cumsum(full)
        marks = np.zeros(len(out), bool)
        marks[ends[cuts[1]] - 1] = True
        out[~marks] = pool[common.ranges(begin, size)]
        out[marks] = [self._mark(words[i][-1]) for i in cuts[1].tolist()]
        return out, full

    @staticmethod
    def _kind(w: str) -> int:
        """0: settled letters; 1: those and a mark behind them, a pre-token of its own; 2: anything else."""
        if w.isalpha():
            return 0 if bpe.settled(w) else 2
        return 1 if w[-1] in ".,|" and w[:-1].isalpha() and bpe.settled(w) else 2

    def _mark(self, c: str) -> int:
        if c not in self.marks:
            (self.marks[c],) = self.tok.encode(c, add_special_tokens=False).ids
        return self.marks[c]

    def forget(self) -> None:
        self.by_words = bpe.ByWords(self._learn, self._learn_words, self.by_words.words.most)

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        rest = [*new]
        return {t: np.array(e.ids, "<u4").tobytes() for t, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True)}

    def _learn_words(self, words: list[str]) -> list[bytes]:
        """One call for all: joined by spaces the text splits there again, and of a word's tokens exactly the first
        starts with a space."""
        ids = np.array(self.tok.encode(" " + " ".join(words), add_special_tokens=False).ids, "<u4")
        at = (np.flatnonzero(self.opens[ids]) * 4).tolist()
        if len(at) != len(words):
            found = self._learn({" " + w for w in words})
            return [found[" " + w] for w in words]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)], strict=True)]


_encoders: dict = {}


def encoder(path: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


MANIFEST = T.StructType(
    [
        T.StructField("shard", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_ids", T.LongType()),
    ]
)


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode every whole text (null: empty) with the library, append end_id, write shards to out_dir in ascending
    doc_id order. Very long texts are encoded whole; an empty table gives no shard; only doc_id and text are read, so
    other columns may have any name.

    One range shuffle puts the rows in order; each task writes its shards under a name that depends on
    its partition alone, first beside and then renamed, so that a repeated task replaces its own files.
    Rows of one doc_id keep to one shard partition, ordered by text. Returns the manifest, which is small:
    one row a shard.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        fs, root = pa.fs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if enc.size <= 1 << 16 else 4
        writer, piece, rows = ShardWriter(width), 0, []

        def flush():
            name = f"part-{part:06d}-{piece:06d}.sst"
            n, ids = len(writer.keys), writer.ids
            beside = f"{root}/_{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(beside, compression=None) as f:
                f.write(writer.finish())
            fs.move(beside, f"{root}/{name}")
            rows.append((name, part, piece, n, ids))

        end = np.array([end_id], "<u4")
        for batch in common.slices(batches, 6 << 20):
            ids = enc.whole_texts(batch.column("text").to_pylist())
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                writer.add(key_of(doc_id), np.concatenate([x, end]))
                if writer.size >= shard_bytes:
                    flush()
                    writer, piece = ShardWriter(width), piece + 1
        if writer.keys:
            flush()
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, r, strict=True)) for r in rows], schema=pa.schema([("shard", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

    src = common.texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = src.repartitionByRange(common.parts(spark, 1), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.cut(ordered.mapInArrow(common.tidied(run), MANIFEST), "sst-manifest")


def read_shards(spark, out_dir: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files alone.

    A file's first id comes from a running sum over the manifest; ids before a record within its file
    are counted while reading.
    """
    common.prepare(spark)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at, rows = 0, {"shard": [], "doc_id": [], "before": [], "n_tokens": [], "ids_crc32": []}
                for key, ids in ShardReader(memoryview(content.as_buffer())):
                    rows["doc_id"].append(id_of(key))
                    rows["before"].append(at)
                    rows["n_tokens"].append(len(ids))
                    rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
                rows["shard"] = [path.rpartition("/")[2]] * len(rows["doc_id"])
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.sst").load(out_dir).select("path", "content")
    records = files.mapInArrow(common.tidied(run), "shard string, doc_id long, before long, n_tokens long, ids_crc32 long")
    return records.join(shard_starts(manifest), "shard").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def shard_starts(manifest: DataFrame) -> DataFrame:
    """shard, first: ids in all shards before it; summed within partitions, then over the partitions' totals."""
    from pyspark.sql import Window

    inner = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    within = manifest.select("shard", "part", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("in_part"))
    return within.join(totals, "part").select("shard", (F.col("base") + F.col("in_part")).alias("first"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6_sstable over the whole documents table: write, then read back."""
    out = common.shared_dir(spark, "sst")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, bpe.default_tokenizer())
    return read_shards(spark, out, manifest)
