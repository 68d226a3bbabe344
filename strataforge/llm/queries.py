"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from strataforge.llm import op1_html, op2_simhash, op3_suffix, op4_pii, op5_quality, op6_mix, op7_warc, op8_urls, op9_embed, op10_pack

QUERIES = {
    "op1_html": op1_html.op1_html,
    "op2_simhash": op2_simhash.op2_simhash,
    "op3_suffix": op3_suffix.op3_suffix,
    "op4_pii": op4_pii.op4_pii,
    "op5_quality_rules": op5_quality.op5_quality_rules,
    "op6_mix": op6_mix.op6_mix,
    "op7_warc": op7_warc.op7_warc,
    "op8_url_filter": op8_urls.op8_url_filter,
    "op9_embedding_groups": op9_embed.op9_embedding_groups,
    "op10_pack": op10_pack.op10_pack,
}

ORACLE_SQL: dict[str, str] = {}
