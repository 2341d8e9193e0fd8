"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, bpe, chat, filter_audit, group_join, html_text, line_dedup, near_dedup, packing, prefix_trie, quality, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": html_text.op1_html_extract,
    "op2_topk_bitsliced": topk.op2_topk_bitsliced,
    "op3_ann_projections": ann.op3_ann_projections,
    "op4_quality_pu": quality.op4_quality_pu,
    "op5_toxicity_gbt": toxicity.op5_toxicity_gbt,
    "op6_bpe_roundtrip": bpe.op6_bpe_roundtrip,
    "op7_chat_format": chat.op7_chat_format,
    "op8_pack_linear_grouping": packing.op8_pack_linear_grouping,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_group_join": group_join.op12_group_join,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk_bitsliced": topk.OP2_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_group_join": group_join.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
