"""The training-data queries by name, and their SQL where SQL expresses them."""

from __future__ import annotations

from . import bpe, jaccard, langid, lm, mixture, pages, quality, sstable, suffix, topk


def queries() -> dict:
    return {
        "op1_topk": topk.query,
        "op2_mixture": mixture.query,
        "op3_pages": pages.query,
        "op4_language": langid.query,
        "op5_jaccard": jaccard.query,
        "op6_sstable": sstable.query,
        "op7_bpe": bpe.query,
        "op8_suffix_dedup": suffix.query,
        "op9_host_quality": quality.query,
        "op10_attention_lm": lm.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.SQL, "op2_mixture": mixture.SQL, "op9_host_quality": quality.SQL}
