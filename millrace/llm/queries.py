"""One query per operator over its whole table, with SQL where there is any.

The others have no SQL: what they return depends on trained models, hashes or
tokenizers. ``tests/llm`` holds them against plain programs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat, manifest, mixing, nearest
from millrace.llm.bpe import op7_bpe
from millrace.llm.chat import op12_chat_format
from millrace.llm.lm import op6_lm_score
from millrace.llm.manifest import op13_merkle_manifest
from millrace.llm.mixing import op3_mix_sources
from millrace.llm.near_duplicates import op5_ngram_jaccard
from millrace.llm.nearest import op8_top_products
from millrace.llm.periodic_runs import op11_periodic_runs
from millrace.llm.pii import op10_pii
from millrace.llm.quality_classifier import op9_quality_classifier
from millrace.llm.quality_rules import op1_quality_rules
from millrace.llm.secrets import op2_secret_scan
from millrace.llm.urls import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality_rules,
        op2_secret_scan,
        op3_mix_sources,
        op4_url_filter,
        op5_ngram_jaccard,
        op6_lm_score,
        op7_bpe,
        op8_top_products,
        op9_quality_classifier,
        op10_pii,
        op11_periodic_runs,
        op12_chat_format,
        op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op8_top_products": nearest.OP8_SQL,
    "op12_chat_format": chat.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
