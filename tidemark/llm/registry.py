"""The queries of this folder, and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, chat, html, media, mixing, simhash, token_counts, topk, toxicity, training_order

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_media_columns": media.op3_media_columns,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_training_order": training_order.op8_training_order,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

ORACLES = {
    "op4_exact_top_k": topk.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
}
