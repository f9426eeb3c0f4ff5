"""Queries and SQL of the corpus operators."""

from kvlake.llm import decontaminate, html_text, lang_id, line_dedup, lm, media, mixing, near_dedup, quality, toxicity

QUERIES = {
    "op1_language_id": lang_id.op1_language_id,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_media_columns": media.op8_media_columns,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality": quality.op10_quality,
    # columns of op7 and op8 that SQL can tell
    "lm_base_scores": lm.lm_base_scores,
    "media_payloads": media.media_payloads,
}

ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "lm_base_scores": lm.BASE_SQL,
    "media_payloads": media.PAYLOADS_SQL,
}
