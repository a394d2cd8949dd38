"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lattica.llm import bpe, chat, decontaminate, fingerprint, jaccard, language, mixing, periodic, pii, quality, secrets, toxicity, vector_codes

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_pii": pii.op2_pii,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_language": language.op6_language,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_secrets": secrets.op10_secrets,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_bpe": bpe.op12_bpe,
    "op13_periodic": periodic.op13_periodic,
}

SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {**QUERIES, "pipeline": _pipeline}


def oracle_sql():
    return dict(SQL)
