"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, neardup, packing, quality_knn, quality_rules, sharding, token_cache, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_warc": warc.op3_warc,
    "op4_token_counts": token_cache.op4_token_counts,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_knn": quality_knn.op6_quality_knn,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_neardup": neardup.op8_neardup,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
}

#: Queries whose rows DuckDB can compute on whole tables. The others are held
#: against plain Python in tests/llm.
ORACLE = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_sharding": sharding.OP5_SQL,
}
