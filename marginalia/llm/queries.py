"""Queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import curve_search, decontaminate, html_text, language_id, line_dedup, lm_score, mixing, ngram_join, quality, token_counts


def queries():
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_language_id": language_id.op2,
        "op3_nearest_neighbours": curve_search.op3,
        "op4_ngram_jaccard_join": ngram_join.op4,
        "op5_mixing": mixing.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_lm_scoring": lm_score.op7,
        "op8_token_counts": token_counts.op8,
        "op9_html_extraction": html_text.op9,
        "op10_quality": quality.op10,
    }


def oracle_sql():
    return {"op1_line_dedup": line_dedup.OP1_SQL}
