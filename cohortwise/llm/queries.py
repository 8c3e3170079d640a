"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from . import chat_format, decontaminate, language_id, line_dedup, mixing, prefix_trie, quality, ranked_search, secret_scan, simhash, suffix_tree_lm, toxicity, warc

_OPERATORS = {
    "op1_toxicity": toxicity,
    "op2_warc": warc,
    "op3_decontaminate": decontaminate,
    "op4_secret_scan": secret_scan,
    "op5_line_dedup": line_dedup,
    "op6_chat_format": chat_format,
    "op7_mixing": mixing,
    "op8_simhash": simhash,
    "op9_quality": quality,
    "op10_language_id": language_id,
    "op11_ranked_search": ranked_search,
    "op12_prefix_trie": prefix_trie,
    "op13_suffix_tree_lm": suffix_tree_lm,
}
QUERIES = {name: module.query for name, module in _OPERATORS.items()}
ORACLE_SQL = {name: module.SQL for name, module in _OPERATORS.items() if getattr(module, "SQL", None)}
