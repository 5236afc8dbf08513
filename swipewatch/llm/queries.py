"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import ann, chat, decontaminate, html, lines, mixing, prefix_trie, quality, repair, simhash, suffix_dedup, tokens, urls

_ALL = [
    (quality.op1_quality_classifier, None),
    (suffix_dedup.op2_suffix_array_dedup, None),
    (decontaminate.op3_benchmark_decontamination, None),
    (mixing.op4_mixing_to_target_weights, None),
    (simhash.op5_simhash_near_dedup, None),
    (lines.op6_line_dedup, lines.SQL),
    (html.op7_html_extraction, None),
    (urls.op8_url_filters, urls.SQL),
    (tokens.op9_token_counts, None),
    (ann.op10_nearest_neighbours, None),
    (repair.op11_conversation_repair, repair.SQL),
    (prefix_trie.op12_conversation_trie, prefix_trie.SQL),
    (chat.op13_chat_formatting, chat.SQL),
]

QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL if sql}
