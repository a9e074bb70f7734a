"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import language_id, learned_partitions, mixing, ngram_lm, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_counts


def queries() -> dict:
    return {
        "op1_ngram_lm": ngram_lm.op1_ngram_lm,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_learned_partitions": learned_partitions.op4_learned_partitions,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_simhash": simhash.op9_simhash,
        "op10_language_id": language_id.op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op2_mixing": mixing.OP2_SQL}
