"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from quern.llm import (
    exact_search,
    hard_negatives,
    line_dedup,
    mixing,
    packing,
    parity_join,
    permutation_index,
    quality,
    secrets,
    substring_dedup,
    toxicity,
    url_filters,
    whitening,
)

QUERIES = {
    "op1_permutation_index": permutation_index.op1_permutation_index,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_parity_join": parity_join.op3_parity_join,
    "op4_packing": packing.op4_packing,
    "op5_exact_top_k": exact_search.op5_exact_top_k,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_secrets": secrets.op12_secrets,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op3_parity_join": parity_join.SQL,
    "op5_exact_top_k": exact_search.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op9_url_filters": url_filters.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
