"""The corpus queries, by name, and their DuckDB twins."""

from __future__ import annotations

from rollcall.llm import queries as q
from rollcall.llm import sql

QUERIES = {
    "op1_sharding": q.op1_sharding,
    "op2_html_text": q.op2_html_text,
    "op3_language_model": q.op3_language_model,
    "op4_near_dedup": q.op4_near_dedup,
    "op5_packing": q.op5_packing,
    "op6_pii": q.op6_pii,
    "op7_language_id": q.op7_language_id,
    "op8_url_filter": q.op8_url_filter,
    "op9_quality": q.op9_quality,
    "op10_decontamination": q.op10_decontamination,
    "op11_secret_scan": q.op11_secret_scan,
    "op12_spelling": q.op12_spelling,
    "op13_prefix_trie": q.op13_prefix_trie,
}
ORACLE = {
    "op1_sharding": sql.OP1,
    "op12_spelling": sql.OP12,
    "op13_prefix_trie": sql.OP13,
}
