"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import collocations, exact_dedup, quality_rules, ranked_search, warc
from .byte_bpe import op8_byte_bpe
from .chat_windows import op11_chat_windows
from .collocations import op12_collocations
from .exact_dedup import op5_exact_dedup
from .importance import op9_importance
from .language_id import op3_language_id
from .license_scan import op1_license_scan
from .mixing import op4_mixing
from .quality_rules import op6_quality_rules
from .ranked_search import op13_ranked_search
from .ring_sharding import op7_ring_sharding
from .simhash import op2_simhash
from .warc import op10_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_ring_sharding": op7_ring_sharding,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_importance": op9_importance,
    "op10_warc": op10_warc,
    "op11_chat_windows": op11_chat_windows,
    "op12_collocations": op12_collocations,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_warc": warc.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
