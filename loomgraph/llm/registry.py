"""Queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import exact_dedup, jaccard_join, mixing, ordinal_quality, packing, quality_rules, substring_dedup, token_store, toxic_crf, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_ordinal_quality": ordinal_quality.query,
    "op4_toxic_crf": toxic_crf.query,
    "op5_warc": warc.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_packing": packing.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_mixing": mixing.query,
    "op10_token_store": token_store.query,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
}
