"""Queries of the corpus operators and the SQL that states the same results."""

from __future__ import annotations

import corpus_pipeline
from polargrain.llm import decontaminate, exact_dedup, language_id, pii, piece_codec, quality_crf, simhash, substring_dedup, token_output, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_simhash": simhash.op2_simhash,
    "op3_token_output": token_output.op3_token_output,
    "op4_sentencepiece": piece_codec.op4_sentencepiece,
    "op5_language_id": language_id.op5_language_id,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_pii": pii.op7_pii,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quality": quality_crf.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
