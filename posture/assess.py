"""A full assessment: grade, store, report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from posture.config import AssessmentConfig
from posture.operators.run import Run
from posture.plans.bank import PILLARS, questions
from posture.plans.scorecard import check_coverage, question_ids, scorecard
from posture.sources.registry import Sources
from posture.sources.results import read_results, run_results, write_results


def questions_of(pillars: Iterable[str] | None = None) -> list[str]:
    """Measured questions of the given areas (default: all), in bank order."""
    if pillars is None:
        return question_ids()
    wanted = set(pillars)
    if wanted - PILLARS.keys():
        raise ValueError(f"unknown areas {sorted(wanted - PILLARS.keys())}")
    area = {q.question_id: q.pillar_id for q in questions()}
    return [q for q in question_ids() if area[q] in wanted]


def assess(
    sources: Sources,
    config: AssessmentConfig,
    results_path: str | None = None,
    pillars: Iterable[str] | None = None,
) -> DataFrame:
    """Grade the questions and return their rows.

    With ``results_path`` the rows are stored (replacing those of the same run and
    areas) and read back. A source that cannot be read, or whose job fails, leaves
    only its own questions open.
    """
    ids = questions_of(pillars)
    check_coverage(ids)
    run = Run(sources, config)
    stored = _store(run, scorecard(run, ids), results_path)
    run.release()
    return stored


def _store(run: Run, rows: DataFrame, results_path: str | None) -> DataFrame:
    if results_path is None:
        rows = rows.persist()
        rows.count()
        return rows
    write_results(rows, results_path)
    return run_results(read_results(run.spark, results_path), run.config.run_id)
