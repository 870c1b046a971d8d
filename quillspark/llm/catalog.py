"""The subpackage's queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from quillspark.llm import decontaminate, exact_dedup, language, licenses, lm_scoring, secrets, sentencepiece_sampling, sharding, simhash, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_secret_scan": secrets.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_lm_scoring": lm_scoring.query,
    "op5_license_scan": licenses.query,
    "op6_sharding": sharding.query,
    "op7_language_id": language.query,
    "op8_decontamination": decontaminate.query,
    "op9_sentencepiece": sentencepiece_sampling.query,
    "op10_simhash_near_dedup": simhash.query,
}

ORACLES = {
    "op2_secret_scan": secrets.sql(),
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_license_scan": licenses.sql(),
}
