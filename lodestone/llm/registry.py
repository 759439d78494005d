"""The corpus queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import ann, chat, decontaminate, html_text, lang_id, lexical, line_dedup, mixing, near_dup, ngram_lm, token_files, turns, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_lm_scores": ngram_lm.op3_lm_scores,
    "op4_reply_trees": chat.op4_reply_trees,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_nearest": ann.op6_nearest,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": lang_id.op8_language_id,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_warc": warc.op10_warc,
    "op11_token_files": token_files.op11_token_files,
    "op12_repair": turns.op12_repair,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLE_SQL = {
    "op4_reply_trees": chat.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_repair": turns.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
