"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from spanloom.llm import byte_bpe, exact_dedup, hard_negatives, line_dedup, near_dedup, pfair_mix, quality_gam, secret_scan, sharding, substring_dedup, token_files, topk_search, whitening

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (topk_search, near_dedup, exact_dedup, quality_gam, substring_dedup, byte_bpe, line_dedup, token_files, pfair_mix, secret_scan, hard_negatives, whitening, sharding):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
