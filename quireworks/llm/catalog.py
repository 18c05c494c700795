"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from quireworks.llm import bpe_words, collision_search, dual_tree_search, exact_dedup, fuzzy_lines, hilbert_packing, jaccard_join, preference_format, prefix_trie, quality_rules, run_length_index, secret_scan, token_files


def queries() -> dict[str, Callable]:
    return {
        "op1_run_length_index": run_length_index.op1_run_length_index,
        "op2_token_files": token_files.op2_token_files,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_fuzzy_lines": fuzzy_lines.op5_fuzzy_lines,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_preference_format": preference_format.op8_preference_format,
        "op9_hilbert_packing": hilbert_packing.op9_hilbert_packing,
        "pipeline": corpus_pipeline.run,
        "op10_bpe_words": bpe_words.op10_bpe_words,
        "op11_dual_tree_search": dual_tree_search.op11_dual_tree_search,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_collision_search": collision_search.op13_collision_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op8_preference_format": preference_format.ORACLE_SQL,
        "op11_dual_tree_search": dual_tree_search.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
