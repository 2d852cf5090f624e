"""Evidence from experiment tracking and model serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.functions.text import filled_json, has_any, lowered
from posture.operators.evidence import Distinct, Pass, Rows
from posture.operators.run import Run
from posture.plans.passes import evidence


@evidence("experiments", "mlflow.experiments_latest")
def experiments(run: Run) -> Pass:
    every = run.sources.frame("mlflow.experiments_latest")
    live = every.where(run.alive(every, "delete_time"))
    return Pass(live, {"experiments.live": Rows()})


@evidence("runs", "mlflow.runs_latest")
def runs(run: Run) -> Pass:
    recent = run.recent("mlflow.runs_latest", "start_time")
    live = recent.where(run.alive(recent, "delete_time"))
    evaluating = has_any(lowered(F.col("run_name")), fixed.EVALUATION_RUN_NAMES) | lowered(
        F.to_json("tags")
    ).rlike(fixed.EVALUATION_RUN_TAGS)
    return Pass(
        live,
        {
            "runs.total": Rows(),
            "runs.evaluating": Rows(evaluating),
            "runs.with_parameters": Rows(filled_json(F.col("params"))),
            "runs.with_metrics": Rows(filled_json(F.col("aggregated_metrics"))),
        },
    )


@evidence("run_metrics", "mlflow.run_metrics_history")
def run_metrics(run: Run) -> Pass:
    name = lowered(F.col("metric_name"))
    return Pass(
        run.recent("mlflow.run_metrics_history", "metric_time"),
        {
            "run_metrics.comparison": Rows(has_any(name, fixed.OUTPUT_COMPARISON_METRICS)),
            "run_metrics.quality": Rows(has_any(name, fixed.OUTPUT_QUALITY_METRICS)),
        },
    )


@evidence("served", "serving.served_entities")
def served(run: Run) -> Pass:
    """Small configuration table: plain distinct counts."""
    every = run.sources.frame("serving.served_entities")
    live = every.where(run.alive(every, "endpoint_delete_time"))
    external = F.col("external_model_config").isNotNull()
    foundation = F.col("foundation_model_config").isNotNull()
    return Pass(
        live,
        {
            "served.endpoints": Distinct("endpoint_id"),
            "served.language_endpoints": Distinct("endpoint_id", external | foundation),
            "served.entities": Distinct("served_entity_id"),
            "served.registered": Distinct(
                "entity_name", F.col("entity_type") == "CUSTOM_MODEL"
            ),
            "served.providers": Distinct("external_model_config.provider"),
            "served.external": Rows(external),
            "served.foundation": Rows(foundation),
            "served.custom": Rows(F.col("custom_model_config").isNotNull()),
            "served.provisioned": Rows(
                F.col("foundation_model_config.max_provisioned_throughput").isNotNull()
            ),
        },
    )
