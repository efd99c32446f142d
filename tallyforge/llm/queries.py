"""Queries of the training-data operators and the SQL forms of those SQL can express."""

from tallyforge.llm import bpe, decontaminate, fingerprints, language_model, near_duplicates, preferences, secrets, token_counts, toxicity, url_templates

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_url_templates": url_templates.op3,
    "op4_secrets": secrets.op4,
    "op5_language_model": language_model.op5,
    "op6_near_duplicates": near_duplicates.op6,
    "op7_token_counts": token_counts.op7,
    "op8_fingerprints": fingerprints.op8,
    "op9_bpe": bpe.op9,
    "op10_preferences": preferences.op10,
}

ORACLE: dict[str, str] = {"op2_decontamination": decontaminate.SQL2, "op6_near_duplicates": near_duplicates.SQL6, "op10_preferences": preferences.SQL10}
