"""Queries of this package by name, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from . import bwt_merge, byte_bpe, jaccard_join, lexical, relative_lz, repair, repetition, token_counts, toxicity, url_filter, warc_zip, winnowing, wrapper
from .oracles import oracle_sql

__all__ = ["queries", "oracle_sql"]


def queries() -> dict:
    return {
        "op1_warc_zip": warc_zip.op1_warc_zip,
        "op2_repetition": repetition.op2_repetition,
        "op3_wrapper": wrapper.op3_wrapper,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_winnowing": winnowing.op5_winnowing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_relative_lz": relative_lz.op8_relative_lz,
        "op9_bwt_merge": bwt_merge.op9_bwt_merge,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_lexical": lexical.op12_lexical,
        "op13_repair": repair.op13_repair,
    }
