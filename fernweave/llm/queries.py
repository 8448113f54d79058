"""The queries opN_<name> of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, jaccard, line_dedup, substring, warc
from .conversations import op13_conversation_repair
from .digest import op4_improbable_features
from .jaccard import op10_ngram_jaccard
from .line_dedup import op12_line_dedup
from .packing import op6_best_fit_packing
from .secrets import op5_secret_scan
from .substring import op8_substring_dedup
from .token_files import op2_token_files
from .toxicity import op3_toxicity
from .transport import op9_transport_streams
from .warc import op1_warc_bundles
from .whitening import op11_embedding_whitening
from .word_table import op7_word_table

ALL = (op1_warc_bundles, op2_token_files, op3_toxicity, op4_improbable_features, op5_secret_scan, op6_best_fit_packing, op7_word_table, op8_substring_dedup, op9_transport_streams, op10_ngram_jaccard, op11_embedding_whitening, op12_line_dedup, op13_conversation_repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": warc.ORACLE_SQL, "op8_substring_dedup": substring.ORACLE_SQL, "op10_ngram_jaccard": jaccard.ORACLE_SQL, "op12_line_dedup": line_dedup.ORACLE_SQL, "op13_conversation_repair": conversations.ORACLE_SQL}
