"""The registered queries of the numbered operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from fleetops.llm import alignment, chat, html_text, jaccard, lang_id, merkle, mixing, outliers, packing, substring, token_files
from fleetops.llm import top_k, url_rules

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_lang_id": lang_id.op2_lang_id,
    "op3_html_text": html_text.op3_html_text,
    "op4_outliers": outliers.op4_outliers,
    "op5_token_files": token_files.op5_token_files,
    "op6_substring": substring.op6_substring,
    "op7_packing": packing.op7_packing,
    "op8_top_k": top_k.op8_top_k,
    "op9_mixing": mixing.op9_mixing,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_merkle": merkle.op11_merkle,
    "op12_url_rules": url_rules.op12_url_rules,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op1_chat": chat.OP1_SQL,
    "op3_html_text": html_text.OP3_SQL,
    "op6_substring": substring.OP6_SQL,
    "op8_top_k": top_k.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_url_rules": url_rules.OP12_SQL,
}
