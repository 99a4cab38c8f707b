"""The queries of this subpackage, by their registered names, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, embedding_dedup, quality_rules, url_filters
from .chat_format import op3_chat_format
from .embedding_dedup import op8_embedding_dedup
from .mixing import op7_source_mixing
from .packing import op4_packing
from .quality_classifier import op2_quality_classifier
from .quality_rules import op5_quality_rules
from .simhash import op9_simhash
from .token_counts import op1_token_counts
from .token_output import op10_token_output
from .url_filters import op6_url_filters


def queries() -> dict:
    found = [op1_token_counts, op2_quality_classifier, op3_chat_format, op4_packing, op5_quality_rules, op6_url_filters, op7_source_mixing, op8_embedding_dedup, op9_simhash, op10_token_output]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat_format.SQL, "op5_quality_rules": quality_rules.SQL, "op6_url_filters": url_filters.SQL, "op8_embedding_dedup": embedding_dedup.SQL}
