"""The queries of this subpackage, as the entry module adds them."""

from __future__ import annotations

import importlib

from heapscope.llm import sql

_WHERE = {
    "op1_suffix_dedup": "substring_bytes",
    "op2_token_files": "token_files",
    "op3_ngram_jaccard": "ngram_join",
    "op4_deficit_packing": "packing",
    "op5_line_crf": "quality_crf",
    "op6_merge_dropout": "pieces",
    "op7_llr_rules": "quality_rules",
    "op8_relative_lz": "lempel_ziv",
    "op9_flac": "flac",
    "op10_sampled_splitters": "sharding",
}
QUERIES = {name: getattr(importlib.import_module(f"heapscope.llm.{module}"), name) for name, module in _WHERE.items()}
ORACLE = {"op1_suffix_dedup": sql.OP1, "op3_ngram_jaccard": sql.OP3, "op8_relative_lz": sql.OP8}
