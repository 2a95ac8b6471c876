"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from manyfold.llm import bpe, exact_dedup, html_text, line_dedup, mixing, quality, secrets, simhash, token_count, topk

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_top_k": topk.op2_top_k,
    "op3_simhash": simhash.op3_simhash,
    "op4_secrets": secrets.op4_secrets,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_counts": token_count.op10_token_counts,
}
ORACLES = {"op2_top_k": topk.ORACLE, "op7_mixing": mixing.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
