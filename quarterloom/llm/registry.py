"""The subpackage's queries and their DuckDB SQL, by name."""

from __future__ import annotations

from .chat_format import OP4_SQL, op4_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .html_extract import op5_html_text
from .mixing import op9_mixing, op9_sql
from .simhash import op7_simhash
from .substring_dedup import OP3_SQL, op3_substring
from .token_files import op8_token_ids
from .topk_search import OP1_SQL, op1_topk
from .toxicity import op6_toxicity
from .url_filter import op2_sql, op2_url_filter

QUERIES = {
    "op1_topk": op1_topk,
    "op2_url_filter": op2_url_filter,
    "op3_substring": op3_substring,
    "op4_chat_format": op4_chat_format,
    "op5_html_text": op5_html_text,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_token_ids": op8_token_ids,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
}
SQL = {"op1_topk": OP1_SQL, "op2_url_filter": op2_sql(), "op3_substring": OP3_SQL, "op4_chat_format": OP4_SQL, "op9_mixing": op9_sql(), "op10_decontaminate": OP10_SQL}
