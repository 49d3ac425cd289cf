"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.byte_bpe import op3_byte_level_bpe
from corpusmill.llm.decontaminate import op9_decontamination
from corpusmill.llm.html_extract import op4_html_extraction
from corpusmill.llm.ngram_join import op1_ngram_jaccard_join
from corpusmill.llm.pii import op8_pii
from corpusmill.llm.quality_rules import op7_quality_rules
from corpusmill.llm.secret_scan import OP2_SQL, op2_secret_scans
from corpusmill.llm.token_counts import op6_token_counts
from corpusmill.llm.toxicity import op5_toxicity
from corpusmill.llm.url_filter import OP10_SQL, op10_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_secret_scans, op3_byte_level_bpe, op4_html_extraction, op5_toxicity, op6_token_counts, op7_quality_rules, op8_pii, op9_decontamination, op10_url_filters)
}

SQL: dict[str, str] = {"op2_secret_scans": OP2_SQL, "op10_url_filters": OP10_SQL}
