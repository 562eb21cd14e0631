"""The operators' queries and the SQL that checks them."""

from __future__ import annotations

from . import chat, cover_tree, decontaminate, packing, pii, secrets, simhash, token_counts, toxicity, url_filter

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_url_filters": url_filter.op3,
    "op4_embedding_near_dedup": cover_tree.op4,
    "op5_secret_scans": secrets.op5,
    "op6_chat_formatting": chat.op6,
    "op7_toxicity": toxicity.op7,
    "op8_pii": pii.op8,
    "op9_packing": packing.op9,
    "op10_token_counts": token_counts.op10,
}
SQL = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op3_url_filters": url_filter.OP3_SQL,
    "op4_embedding_near_dedup": cover_tree.OP4_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
}
