"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from .chat import op1_chat_quotations
from .langid import op10_language_id
from .lm import op2_lm_scoring
from .mixing import op7_mixing
from .neardup import op4_embedding_dedup
from .packing import op9_packing
from .pages import op8_html_extraction
from .quality import op3_quality_classifier
from .rules import op5_quality_rules
from .simhash import op6_simhash_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_quotations, op2_lm_scoring, op3_quality_classifier, op4_embedding_dedup, op5_quality_rules,
        op6_simhash_dedup, op7_mixing, op8_html_extraction, op9_packing, op10_language_id,
    )
}

ORACLE_SQL: dict[str, str] = {}
