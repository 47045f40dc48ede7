"""Operator 4: language identification by rank-order profiles.

A profile lists n-grams (1 to 3 letters, word edges included) in order of frequency. A text's profile is compared
to each language's: every n-gram counts by how far out of place it is, or the most possible if it is missing.
Learning counts n-grams over all training texts; counts meet by language and n-gram, and only the finished
profiles, of fixed length, come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PROFILE, TEXT_PROFILE, EDGE = 400, 300, 95
_letters: dict = {}


def letter_table(codes: np.ndarray) -> np.ndarray:
    """Whether each code point up to the largest is a letter; grown as needed, one test a code point."""
    top = int(codes.max(initial=0)) + 1
    have = _letters.get("t", np.zeros(0, bool))
    if len(have) < top:
        top = max(top, 0x600)
        have = np.concatenate([have, np.fromiter((chr(c).isalpha() for c in range(len(have), top)), bool, top - len(have))])
        _letters["t"] = have
    return have


def counted(texts: list[str]):
    """(doc, gram, count) of all texts in order of doc; a gram is up to three code points of 21 bits, 0 in front."""
    lowered = [t.lower() for t in texts]
    flat = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass") or b"", np.uint32)
    lengths = np.array([len(t) for t in lowered], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), lengths + 1)[: len(flat)]
    letter = letter_table(flat)[flat]
    at_end = np.cumsum(lengths + 1) - 1
    letter[at_end[:-1]] = False
    c = np.where(letter, flat, EDGE).astype(np.int64)
    # one edge before and one after each word
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c, doc = c[keep], doc[keep]
    if not len(c):
        return (np.zeros(0, np.int64),) * 3
    if c[-1] != EDGE:
        c, doc = np.append(c, EDGE), np.append(doc, doc[-1])
    used = np.flatnonzero(np.bincount(c))
    dense = np.zeros(int(used[-1]) + 1, np.int64)
    dense[used] = np.arange(len(used))
    d, edge, k = dense[c], c == EDGE, len(used)
    before = np.concatenate([[int(dense[EDGE])], d[:-1]])
    two = np.concatenate([[int(dense[EDGE])], before[:-1]])
    edge_before = np.concatenate([[True], edge[:-1]])
    edge_two = np.concatenate([[True], edge[:-1]])
    edge_two = np.concatenate([[True], edge_two[:-1]])
    if (k + 1) ** 3 > (1 << 62) // max(len(texts), 1):  # so many letters that keys would run over: by halves
        if len(texts) < 2:
            raise ValueError("more distinct letters in a text than there are in Unicode")
        half = len(texts) // 2
        first, second = counted(texts[:half]), counted(texts[half:])
        return np.concatenate([first[0], second[0] + half]), *(np.concatenate(x) for x in zip(first[1:], second[1:], strict=True))
    # letters; pairs of neighbours; triples with no edge in the middle
    kinds = [(~edge, d + 1), (np.ones(len(d), bool), (before + 1) * (k + 1) + d + 1), (~edge_before, ((two + 1) * (k + 1) + before + 1) * (k + 1) + d + 1)]
    space = (k + 1) ** 3
    keys = np.sort(np.concatenate([doc[m] * space + g[m] for m, g in kinds]))
    first = common.runs(keys)
    n = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    doc, g = keys // space, keys % space
    parts = []
    for _ in range(3):
        g, low = np.divmod(g, k + 1)
        parts.append(np.where(low > 0, used[np.maximum(low - 1, 0)], 0))
    return doc, parts[0] | parts[1] << 21 | parts[2] << 42, n


def ranked(doc: np.ndarray, gram: np.ndarray, n: np.ndarray, most: int):
    """The most frequent grams of each doc with their ranks, ties by gram."""
    order = np.lexsort((gram, -n, doc))
    doc, gram = doc[order], gram[order]
    first = common.runs(doc)
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    keep = rank < most
    return doc[keep], gram[keep], rank[keep]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text): counts meet after each slice's are summed."""

    def run(batches):
        for batch in common.slices(batches, 2 << 20):
            langs, place = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            doc, gram, n = counted(batch.column("text").to_pylist())
            lang = place[doc] if len(doc) else doc
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(lang) != 0) | (np.diff(gram) != 0)])) if len(gram) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            yield pa.RecordBatch.from_arrays([pa.array(langs[lang[first]].tolist(), pa.string()), pa.array(gram[first]), pa.array(total)], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(common.tidied(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, length: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's grams in order of frequency: length rows a language, however large the corpus."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = gram_counts(docs).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= length).orderBy("lang", "r").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def nearest(texts: list[str], known: dict[str, np.ndarray], length: int = PROFILE, most: int = TEXT_PROFILE):
    """The language of least out-of-place distance and 1 - distance / the greatest possible, for each text."""
    names = sorted(known)
    if not names:
        return ["und"] * len(texts), [0.0] * len(texts)
    doc, gram, rank = ranked(*counted(texts), most)
    grams = np.unique(np.concatenate([known[n] for n in names]))
    table = np.full((len(names), len(grams) + 1), -1, np.int64)
    for i, n in enumerate(names):
        table[i, np.searchsorted(grams, known[n])] = np.arange(len(known[n]))
    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    at = np.where(grams[at] == gram, at, len(grams))
    distance = np.empty((len(names), len(texts)))
    for i in range(len(names)):
        place = table[i, at]
        off = np.where(place < 0, length, np.minimum(np.abs(place - rank), length))
        distance[i] = np.bincount(doc, off, len(texts))
    size = np.bincount(doc, minlength=len(texts))
    best = distance.argmin(0)
    score = 1 - distance[best, np.arange(len(texts))] / np.maximum(size * length, 1)
    return [names[b] if s else "und" for b, s in zip(best, size, strict=True)], np.where(size > 0, score, 0.0).tolist()


def identify(docs: DataFrame, divisor: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from rows not held out whose lang is not null.

    A null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn from.
    Very long texts are profiled whole; repeated rows get the same prediction; an empty table gives no row. Of equal
    distances the language first by code point wins.
    """
    common.prepare(docs.sparkSession)
    src = common.texts(docs.select("doc_id", "lang", "text"), "doc_id", "lang").withColumn("held_out", common.held_out("doc_id", divisor))
    known = profiles(src.filter(~F.col("held_out") & F.col("lang").isNotNull()))

    def run(batches):
        for batch in common.slices(batches, 2 << 20):
            lang, score = nearest(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = src.select("doc_id", "held_out", "text")
    return rows.mapInArrow(common.tidied(run), rows.drop("text").schema.add("lang_pred", "string").add("score", "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4_language over the whole documents table."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
