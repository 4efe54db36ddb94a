"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import counts, decontamination, jaccard, language, licenses, lines, pieces, quality, substrings, urls

QUERIES = {
    "op1_substring_dedup": substrings.query,
    "op2_url_filters": urls.query,
    "op3_line_dedup": lines.query,
    "op4_license_scans": licenses.query,
    "op5_benchmark_decontamination": decontamination.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_token_counts": counts.query,
    "op8_sentencepiece": pieces.query,
    "op9_quality_rules": quality.query,
    "op10_language_id": language.query,
}

ORACLES = {
    "op2_url_filters": urls.ORACLE,
    "op5_benchmark_decontamination": decontamination.ORACLE,
}
