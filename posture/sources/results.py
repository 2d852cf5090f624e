"""The result table and its exports."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "run_id string, run_timestamp timestamp, pillar string, question_id string,"
    " principle string, question string, status string, reason string, metrics_json string"
)
COLUMNS = tuple(c.strip().split(" ")[0] for c in RESULT_SCHEMA.split(","))
PARTITIONS = ("run_id", "pillar")
ROWS, ATTEMPTS = "rows", "attempts"
ATTEMPT_SCHEMA = "run_id string, pillar string, attempt string, n bigint"
EXPORTED = ("pillar", "question_id", "principle", "question", "status", "reason")


def ensure_table(spark: SparkSession, table: str) -> str:
    """Create the schema and the result table when they are missing."""
    if "." in table:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({RESULT_SCHEMA}) USING PARQUET"
        f" PARTITIONED BY ({', '.join(PARTITIONS)})"
    )
    return table


def write_results(scorecard: DataFrame, path: str) -> None:
    """Replace the run's rows of every area in ``scorecard``; keep all others.

    Rows are written under an attempt of their own and count only once the attempt is noted,
    for all its areas by one small file. So a reader sees an attempt whole or not at all,
    and one that broke off leaves what was there. Only the areas present in ``scorecard``
    are replaced: running one again does not add rows, and an empty scorecard changes
    nothing. Superseded attempts stay in the folder until its owner removes them.
    """
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    (
        scorecard.select(*COLUMNS)
        .withColumn("attempt", F.lit(attempt))
        .write.mode("append")
        .partitionBy(*PARTITIONS, "attempt")
        .parquet(f"{path}/{ROWS}")
    )
    _note(scorecard.sparkSession, path, attempt)


def _note(spark: SparkSession, path: str, attempt: str) -> None:
    """Make an attempt count: the areas it holds, in one file."""
    written = _all_rows(spark, path).where(F.col("attempt") == attempt)
    areas = written.groupBy(*PARTITIONS, "attempt").agg(F.count(F.lit(1)).alias("n"))
    areas.coalesce(1).write.mode("append").parquet(f"{path}/{ATTEMPTS}")


def _all_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RESULT_SCHEMA}, attempt string").parquet(f"{path}/{ROWS}")


def write_results_table(scorecard: DataFrame, table: str) -> None:
    """As :func:`write_results`, into a catalog table (created when missing).

    A plain table holds no attempts: its partitions are overwritten one after the other.
    """
    spark = scorecard.sparkSession
    ensure_table(spark, table)
    ordered = [c for c in COLUMNS if c not in PARTITIONS] + list(PARTITIONS)
    (
        scorecard.select(*ordered)
        .write.option("partitionOverwriteMode", "dynamic")
        .insertInto(table, overwrite=True)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest noted attempt of every run and area."""
    rows = _all_rows(spark, path)
    noted = spark.read.schema(ATTEMPT_SCHEMA).parquet(f"{path}/{ATTEMPTS}")
    newest = noted.groupBy(*PARTITIONS).agg(F.max("attempt").alias("attempt"))
    same = rows["attempt"] == newest["attempt"]
    for name in PARTITIONS:
        same = same & rows[name].eqNullSafe(newest[name])
    return rows.join(newest, same, "left_semi").select(*COLUMNS)


def run_results(results: DataFrame, run_id: str) -> DataFrame:
    """The rows of one run in report order (prunes to the run's partitions)."""
    return results.where(F.col("run_id") == run_id).orderBy("pillar", "question_id")


def stored_or(spark: SparkSession, path: str, run_id: str, fresh: DataFrame) -> DataFrame:
    """A run's stored rows, or the fresh ones when nothing is stored for it."""
    try:
        stored = run_results(read_results(spark, path), run_id)
        if stored.limit(1).count():
            return stored
    except AnalysisException:
        pass
    return fresh.select(*COLUMNS).orderBy("pillar", "question_id")


def write_csv(results: DataFrame, path: str) -> None:
    """The six report columns as one CSV file; a run has at most 151 rows."""
    (
        results.select(*EXPORTED)
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )
