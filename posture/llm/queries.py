"""Queries of this folder and, where SQL can express them, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from posture.llm.alignment import op13_cross_tokenizer_alignment
from posture.llm.benchmark import OP7_SQL, op7_benchmark_decontamination
from posture.llm.fingerprints import OP1_SQL, op1_document_fingerprints
from posture.llm.language import op6_language_id
from posture.llm.line_dedup import OP3_SQL, op3_line_dedup
from posture.llm.packing import op5_packing
from posture.llm.pages import op2_html_extraction
from posture.llm.quality import op10_quality_classifier
from posture.llm.simhash import op4_simhash_near_dedup
from posture.llm.substrings import OP9_SQL, op9_substring_dedup
from posture.llm.topk import OP12_SQL, op12_exact_top_k
from posture.llm.toxicity import op8_toxicity
from posture.llm.whitening import op11_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLE_SQL = {
    "op1_document_fingerprints": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op12_exact_top_k": OP12_SQL,
}
