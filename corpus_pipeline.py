"""Corpus pipeline: quality rules, near-duplicate join, repeated passages, source mix, token ids.

Every stage works on all that the stage before it kept, is written as Parquet and read again, so a lost executor
costs no more than the stage it was in. All stages but the last return the columns of documents, whatever further
columns there are and whatever they are called. The mix writes its rows in training order; the last stage tells the
place of each row in the mix's files, so its ids can be read in that order wherever they were computed.
"""

from __future__ import annotations

from orrery.llm import bpe, common, jaccard, mixture, quality, suffix


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the rules, judged with their host's record, go; a document's host is its source.

    Null, empty and blank texts fail and go. A null source is a host like another. Rows that repeat are judged alike;
    very long texts are measured whole; an empty table stays empty.
    """
    return quality.kept_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of documents linked by five-word strings at similarity 0.8 or more, the one of least doc_id stays.

    Rows without a doc_id and texts without a word link to nothing and stay. Of rows that repeat a doc_id and its text
    one stays; with another text they are documents of their own. Very long texts are compared whole; an empty table
    stays empty.
    """
    return jaccard.representatives(docs)


def repeated_passages(spark, docs, sf_dir):
    """Bytes of strings of 100 that also start earlier are cut; documents of which nothing is left go.

    Null texts become empty ones and stay. Texts shorter than 100 bytes lose nothing; very long ones are handled whole.
    Rows that repeat a doc_id and its text are one document; with another text they are ordered by a hash of it; a null
    id comes first. An empty table stays empty.
    """
    return suffix.without_repeats(docs)


def source_mix(spark, docs, sf_dir):
    """Sources at their target weights in training order; a document stands once for each round that takes it.

    Null texts and texts without a word are never taken. A null source is a source like another. Rows that repeat are
    taken one after another; very long texts are taken whole; an empty table stays empty.
    """
    return mixture.mixed_documents(docs)


def token_ids(spark, docs, sf_dir):
    """Token ids of every text, whether they decode to it, and the row's place (shard, row) in the order of the mix.

    Null texts are empty and have no id. Rows that repeat each have theirs; very long texts are encoded whole; an empty
    table gives none.
    """
    return bpe.encoded_documents(docs, bpe.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Suffix arrays and byte-pair merges have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages one after another over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return docs
