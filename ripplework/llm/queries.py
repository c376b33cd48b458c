"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op5_bpe
from .html_text import op1_html_text
from .line_dedup import OP8_SQL, op8_line_dedup
from .packing import op9_packing
from .pii import op7_pii
from .quality_rules import OP3_SQL, op3_quality_rules
from .repeats import op6_suffix_dedup
from .shingle_join import op10_ngram_jaccard
from .spotsigs import op4_spotsigs
from .token_counts import op2_token_counts

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_spotsigs": op4_spotsigs,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLE = {
    "op3_quality_rules": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
}
