"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet
and read again as the docs of the next one; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from posture.llm.benchmark import decontamination_stage
from posture.llm.common import shared_folder, table
from posture.llm.line_dedup import line_dedup_stage
from posture.llm.packing import packing_stage
from posture.llm.quality import quality_stage
from posture.llm.simhash import near_dedup_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The quality model, the fingerprints and the vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
