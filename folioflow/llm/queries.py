"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_counts, token_output, url_filters, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_near_dedup": near_dedup.query,
    "op3_sharding": sharding.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_token_counts": token_counts.query,
    "op6_token_output": token_output.query,
    "op7_mixing": mixing.query,
    "op8_warc": warc.query,
    "op9_quality_rules": quality_rules.query,
    "op10_url_filters": url_filters.query,
}

ORACLES = {
    "op1_decontamination": decontamination.ORACLE_SQL,
    "op2_near_dedup": near_dedup.ORACLE_SQL,
    "op4_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_url_filters": url_filters.ORACLE_SQL,
}
