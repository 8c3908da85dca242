"""The registered corpus queries, each with the DuckDB SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from loadwatch.llm import decontaminate, language, merkle, mixing, quality, quotes, scoring, secrets, simhash, tokens, toxicity, warc, whitening

QUERIES = {
    "op1_lm_score": (scoring.op1_lm_score, None),
    "op2_token_counts": (tokens.op2_token_counts, None),
    "op3_curriculum": (mixing.op3_curriculum, mixing.OP3_SQL),
    "op4_host_rules": (quality.op4_host_rules, quality.OP4_SQL),
    "op5_language": (language.op5_language, None),
    "op6_simhash": (simhash.op6_simhash, None),
    "op7_decontaminate": (decontaminate.op7_decontaminate, decontaminate.OP7_SQL),
    "op8_warc": (warc.op8_warc, warc.OP8_SQL),
    "op9_secrets": (secrets.op9_secrets, None),
    "op10_quotes": (quotes.op10_quotes, None),
    "op11_whitening": (whitening.op11_whitening, None),
    "op12_toxicity": (toxicity.op12_toxicity, None),
    "op13_merkle": (merkle.op13_merkle, merkle.OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
