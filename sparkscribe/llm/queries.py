"""The queries of this package and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, language, mixing, phrases, simhash, substring_dedup, suffix_dedup, token_counts, topk, toxicity, url_filters, whitening


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_simhash": simhash.op2_simhash,
        "op3_topk": topk.op3_topk,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_html_text": html_text.op8_html_text,
        "op9_language_id": language.op9_language_id,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_url_filters": url_filters.op11_url_filters,
        "op12_phrases": phrases.op12_phrases,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql():
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op3_topk": topk.OP3_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op7_suffix_dedup": suffix_dedup.OP7_SQL,
        "op11_url_filters": url_filters.OP11_SQL,
        "op12_phrases": phrases.OP12_SQL,
    }
