"""The operators' registered queries, and their SQL for DuckDB where there is one."""

from skipscan.llm import chat, decontaminate, html, licences, linededup, minhash, packing, pii, quality, sharding

QUERIES = {
    "op1_pii_pseudonyms": pii.op1,
    "op2_html_main_text": html.op2,
    "op3_packing": packing.op3,
    "op4_line_dedup": linededup.op4,
    "op5_license_scan": licences.op5,
    "op6_minhash_near_dedup": minhash.op6,
    "op7_quality_rules": quality.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_sharding": sharding.op9,
    "op10_chat_formatting": chat.op10,
}

ORACLE_SQL = {
    "op4_line_dedup": linededup.OP4_SQL,
    "op6_minhash_near_dedup": minhash.OP6_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
