"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civitext.llm.ann_search import op4_nearest_neighbours
from civitext.llm.byte_bpe import op9_byte_bpe
from civitext.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from civitext.llm.embedding_dedup import op2_embedding_dedup
from civitext.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from civitext.llm.html_blocks import op7_html_extraction
from civitext.llm.hyperminhash import op10_minhash_near_dedup
from civitext.llm.mixing import OP8_SQL, op8_mixing
from civitext.llm.quality_cnn import op5_quality_classifier
from civitext.llm.secret_scan import op6_secret_scan
from civitext.llm.substring_dedup import op1_substring_dedup
from civitext.llm.token_files import op3_token_files
from civitext.llm.toxicity_kernel import op13_toxicity

QUERIES = [
    op1_substring_dedup,
    op2_embedding_dedup,
    op3_token_files,
    op4_nearest_neighbours,
    op5_quality_classifier,
    op6_secret_scan,
    op7_html_extraction,
    op8_mixing,
    op9_byte_bpe,
    op10_minhash_near_dedup,
    op11_conversation_repair,
    op12_hard_negatives,
    op13_toxicity,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The other queries are tested against brute force, round trips or held-out rows."""
    return {"op8_mixing": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_hard_negatives": OP12_SQL}
