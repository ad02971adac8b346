"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from textmap.llm import chat, decontaminate, html_text, licenses, mixing, near_dedup, quality, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_perspective_rotation": chat.op1_perspective_rotation,
    "op2_warc_index": warc.op2_warc_index,
    "op3_risk_controlled_rules": quality.op3_risk_controlled_rules,
    "op4_sparse_suffix_array": suffix_dedup.op4_sparse_suffix_array,
    "op5_hashed_expressions": url_filter.op5_hashed_expressions,
    "op6_max_subsequence": html_text.op6_max_subsequence,
    "op7_raking": mixing.op7_raking,
    "op8_signature_rules": licenses.op8_signature_rules,
    "op9_hyperminhash": near_dedup.op9_hyperminhash,
    "op10_spaced_seeds": decontaminate.op10_spaced_seeds,
}
ORACLES = {
    "op1_perspective_rotation": chat.SQL,
    "op2_warc_index": warc.SQL,
    "op3_risk_controlled_rules": quality.SQL,
    "op5_hashed_expressions": url_filter.SQL,
    "op7_raking": mixing.SQL,
    "op9_hyperminhash": near_dedup.SQL,
}
