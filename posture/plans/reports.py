"""Report tables over scorecard rows (pillar, question_id, status, ...)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posture.fixed_values import COMPLETED, IN_PROGRESS, MANUAL, OPEN
from posture.functions.grading import percent, status_rank
from posture.plans.bank import question_bank
from posture.plans.rules import RULES

REPORT_ORDER = (COMPLETED, IN_PROGRESS, OPEN, MANUAL)


def _is(status: str) -> Column:
    return F.col("status") == status


def _score() -> Column:
    """Completed share of the machine-checkable questions, NULL without any."""
    scored = F.count_if(F.col("status").isin(OPEN, IN_PROGRESS, COMPLETED))
    return F.round(percent(F.count_if(_is(COMPLETED)), scored), 1)


def _every_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, s) for i, s in enumerate(REPORT_ORDER)], "position int, status string"
    )


def status_summary(rows: DataFrame) -> DataFrame:
    """Rows per status, all four statuses listed."""
    counted = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return (
        _every_status(rows.sparkSession)
        .join(counted, "status", "left")
        .select("position", "status", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("position")
        .drop("position")
    )


def status_share(rows: DataFrame) -> DataFrame:
    """As :func:`status_summary`, with the share of all rows (four rows in all)."""
    summary = status_summary(rows)
    everything = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return summary.select(
        "status", "n", F.round(percent(F.col("n"), everything), 1).alias("share_pct")
    )


def maturity(rows: DataFrame) -> DataFrame:
    """Completed questions, machine-checkable questions and the score."""
    return rows.agg(
        F.count_if(_is(COMPLETED)).alias("completed"),
        F.count_if(F.col("status").isin(OPEN, IN_PROGRESS, COMPLETED)).alias("scored"),
        _score().alias("score_pct"),
    )


def by_pillar(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("pillar")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.count_if(_is(COMPLETED)).alias("completed"),
            F.count_if(_is(IN_PROGRESS)).alias("in_progress"),
            F.count_if(_is(OPEN)).alias("open"),
            F.count_if(_is(MANUAL)).alias("manual_review"),
            _score().alias("score_pct"),
        )
        .orderBy("pillar")
    )


def by_pillar_and_status(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("pillar", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("pillar", "status")
    )


def priority_findings(rows: DataFrame) -> DataFrame:
    """Open, then in-progress questions."""
    return rows.where(F.col("status").isin(OPEN, IN_PROGRESS)).orderBy(
        status_rank(F.col("status")), "question_id"
    )


def top_findings(rows: DataFrame, pillar: str, k: int = 10) -> DataFrame:
    """The first findings of an area by status, in bank order within a status."""
    return (
        rows.where(F.col("pillar") == pillar)
        .orderBy(status_rank(F.col("status")), "ordinal")
        .limit(k)
    )


def detail(rows: DataFrame) -> DataFrame:
    """All rows by area and principle in bank order."""
    return rows.orderBy("pillar_ordinal", "ordinal").select(
        "pillar", "principle", "question_id", "question", "status", "reason"
    )


def manual_checklist(rows: DataFrame) -> DataFrame:
    return rows.where(_is(MANUAL)).orderBy("question_id")


def open_questions(rows: DataFrame) -> DataFrame:
    return rows.where(_is(OPEN)).orderBy("pillar", "question_id")


def history(results: DataFrame, question_id: str) -> DataFrame:
    """One question across runs, newest first."""
    return results.where(F.col("question_id") == question_id).orderBy(
        F.desc("run_timestamp"), "run_id"
    )


def unmeasured(spark: SparkSession) -> DataFrame:
    """Bank questions without a rule, per area."""
    known = spark.createDataFrame([(q,) for q in RULES], "question_id string")
    return (
        question_bank(spark)
        .join(F.broadcast(known), "question_id", "left_anti")
        .groupBy("pillar")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def coverage_gaps(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    """Questions of the covered areas without a rule, and rules without a question."""
    rules = spark.createDataFrame([(q,) for q in ids], "question_id string")
    bank = question_bank(spark)
    covered = bank.join(F.broadcast(rules), "question_id").select("pillar_id").distinct()
    expected = bank.join(covered, "pillar_id", "left_semi").select("question_id")
    missing = expected.join(rules, "question_id", "left_anti")
    unknown = rules.join(bank, "question_id", "left_anti")
    return missing.withColumn("problem", F.lit("no rule")).unionByName(
        unknown.withColumn("problem", F.lit("not in the bank"))
    )
