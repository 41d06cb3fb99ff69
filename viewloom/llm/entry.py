"""Queries and SQL of the operators, for __spark_entry__."""

from __future__ import annotations

from . import op1_pii, op2_sharding, op3_langid, op4_jaccard, op4_sql, op5_secrets, op6_licenses, op7_decontam, op8_html, op9_packing, op10_imatch

QUERIES = {
    "op1_pii_boosting": op1_pii.query,
    "op2_hash_tree_sharding": op2_sharding.query,
    "op3_language_id": op3_langid.query,
    "op4_jaccard_join": op4_jaccard.query,
    "op5_secret_ledger": op5_secrets.query,
    "op6_license_classifier": op6_licenses.query,
    "op7_decontamination": op7_decontam.query,
    "op8_html_templates": op8_html.query,
    "op9_best_fit_packing": op9_packing.query,
    "op10_imatch_fingerprints": op10_imatch.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": op4_sql.SQL,
    "op7_decontamination": op7_decontam.SQL,
}
