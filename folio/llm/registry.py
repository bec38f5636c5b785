"""Queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import exact_dedup, html_text, jaccard, mixing, packing, quality, secrets, sharding, suffix_dedup, webp

QUERIES = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_line_block_text": html_text.op2_line_block_text,
    "op3_empirical_bayes_quality": quality.op3_empirical_bayes_quality,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_lexical_packing": packing.op5_lexical_packing,
    "op6_histogram_shards": sharding.op6_histogram_shards,
    "op7_lossless_webp": webp.op7_lossless_webp,
    "op8_splitting_tree_mix": mixing.op8_splitting_tree_mix,
    "op9_secret_ledger": secrets.op9_secret_ledger,
    "op10_extendible_hash_dedup": exact_dedup.op10_extendible_hash_dedup,
}
ORACLES = {
    "op9_secret_ledger": secrets.OP9_SQL,
    "op10_extendible_hash_dedup": exact_dedup.OP10_SQL,
}
