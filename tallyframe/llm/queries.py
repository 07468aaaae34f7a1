"""Registered corpus queries (opN_<name>) and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from .q_chat import OP7_SQL, op7_chat_format
from .q_decontaminate import op5_decontaminate
from .q_minhash import OP9_SQL, op9_minhash_dedup
from .q_passages import op10_substring_dedup
from .q_pieces import op6_sentencepiece
from .q_quality import op3_quality_classifier
from .q_quality_rules import op8_quality_rules
from .q_token_files import op2_token_files
from .q_toxicity import op4_toxicity
from .q_urls import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_token_files": op2_token_files,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op7_chat_format": OP7_SQL, "op9_minhash_dedup": OP9_SQL}
