"""Evidence from configuration histories, each reduced to latest versions once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posture import fixed_values as fixed
from posture.functions.text import filled_json, has_any, lowered
from posture.operators.evidence import (
    Groups,
    GroupTest,
    Lowest,
    Mean,
    Pass,
    Rows,
    Top,
    Total,
)
from posture.operators.latest import IS_NEWEST, TIE_BREAK, latest, newest_and_counts
from posture.operators.run import Run
from posture.operators.scope import IN_SCOPE
from posture.plans.passes import evidence
from posture.sources.schemas import SCHEMAS

LIVE = "delete_time"


def _narrow(source: str, history: DataFrame, *more: str) -> DataFrame:
    """Dropping columns that nothing reads keeps them out of the scan and the tie-break."""
    known = {f.name for f in T.StructType.fromDDL(SCHEMAS[source])} | {TIE_BREAK, *more}
    return history.select(*(c for c in history.columns if c in known))


def _latest(
    run: Run, source: str, history: DataFrame, key: str, at: str = "change_time", live: str = LIVE
) -> DataFrame:
    """Latest live versions, with only the columns that measurements read."""
    narrow = _narrow(source, history)
    return latest(
        narrow.where(run.known(narrow, at)),
        key,
        at,
        run.alive(narrow, live),
        run.config.rank_before_live_filter,
    )


@evidence("jobs", "lakeflow.jobs")
def jobs(run: Run) -> Pass:
    frame = _latest(run, "lakeflow.jobs", run.sources.frame("lakeflow.jobs"), "job_id")
    name = lowered(F.col("name"))
    triggers = ("schedule", "file_arrival", "periodic", "table_update", "continuous")
    triggered = F.lit(False)
    for kind in triggers:
        triggered = triggered | F.col(f"trigger.{kind}").isNotNull()
    on_event = (
        F.col("trigger.file_arrival").isNotNull() | F.col("trigger.table_update").isNotNull()
    )
    return Pass(
        frame,
        {
            "jobs.versions": Rows(),
            "jobs.total": Rows(F.col("job_id").isNotNull()),
            "jobs.deployed": Rows(F.col("deployment.kind").isNotNull()),
            "jobs.triggered": Rows(triggered),
            "jobs.paused": Rows(F.col("paused")),
            "jobs.file_arrival": Rows(F.col("trigger.file_arrival").isNotNull()),
            "jobs.event_driven": Rows(on_event),
            "jobs.continuous": Rows(F.col("trigger.continuous.enabled")),
            "jobs.with_timeout": Rows(F.col("timeout_seconds") > 0),
            "jobs.with_health_rules": Rows(filled_json(F.col("health_rules"))),
            "jobs.learning": Rows(has_any(name, fixed.LEARNING_JOB_NAMES)),
            "jobs.evaluation": Rows(has_any(name, fixed.EVALUATION_JOB_NAMES)),
        },
    )


@evidence("tasks", "lakeflow.job_tasks")
def tasks(run: Run) -> Pass:
    every = run.sources.frame("lakeflow.job_tasks")
    frame = every.where(run.alive(every, LIVE))
    return Pass(
        frame,
        {
            "tasks.dependent_jobs": Groups(F.size("depends_on_keys") > 0),
            "tasks.large_jobs": GroupTest(None, lambda n: n > fixed.MANY_TASKS),
        },
        carrier=("job_id",),
    )


@evidence("pipelines", "lakeflow.pipelines")
def pipelines(run: Run) -> Pass:
    """Latest versions, and all live ones for the questions that count these."""
    every = _narrow("lakeflow.pipelines", run.sources.frame("lakeflow.pipelines"))
    every = every.where(run.known(every, "change_time"))
    live = run.alive(every, LIVE)
    kind = lowered(F.col("pipeline_type"))
    frame = newest_and_counts(
        every,
        "pipeline_id",
        "change_time",
        live,
        {
            "_versions": live,
            "_ingestion": live & has_any(kind, fixed.INGESTION_PIPELINES),
            "_continuous": live & F.col("settings.continuous"),
        },
        run.config.rank_before_live_filter,
    )
    newest = F.col(IS_NEWEST)
    return Pass(
        frame,
        {
            "pipelines.total": Rows(newest),
            "pipelines.serverless": Rows(newest & F.col("settings.serverless")),
            "pipelines.continuous": Rows(newest & F.col("settings.continuous")),
            "pipelines.development": Rows(newest & F.col("settings.development")),
            "pipelines.versions": Total(F.col("_versions")),
            "pipelines.ingestion_versions": Total(F.col("_ingestion")),
            "pipelines.continuous_versions": Total(F.col("_continuous")),
        },
    )


@evidence("clusters", "compute.clusters")
def clusters(run: Run) -> Pass:
    low, high = F.col("min_autoscale_workers"), F.col("max_autoscale_workers")
    workers = F.coalesce(high, F.col("worker_count"), F.lit(0))
    # No digits in front means no major version.
    major = F.regexp_extract(F.coalesce("dbr_version", F.lit("")), "^([0-9]+)", 1).try_cast(
        "int"
    )
    idle = F.col("auto_termination_minutes")
    interactive = ~lowered(F.col("cluster_source")).isin(*fixed.AUTOMATED_CLUSTER_SOURCES)
    on_demand_first = F.col("aws_attributes.first_on_demand").try_cast("int")
    spot = (
        (F.coalesce(on_demand_first, F.lit(fixed.ON_DEMAND_ONLY)) < fixed.ON_DEMAND_ONLY)
        | lowered(F.to_json("azure_attributes")).contains("spot")
        | lowered(F.to_json("gcp_attributes")).contains("preemptible")
    )
    frame = _latest(
        run, "compute.clusters", run.recent("compute.clusters", "change_time"), "cluster_id"
    )
    return Pass(
        frame,
        {
            "clusters.total": Rows(),
            "clusters.with_policy": Rows(F.col("policy_id") != ""),
            "clusters.autoscaling": Rows(high > F.coalesce(low, F.lit(0))),
            "clusters.multi_worker": Rows(workers >= 2),
            "clusters.single_node": Rows(workers == 0),
            "clusters.workers": Mean(workers),
            "clusters.current_runtime": Rows(major >= fixed.CURRENT_RUNTIME_MAJOR),
            "clusters.oldest_major": Lowest(major),
            "clusters.interactive": Rows(interactive),
            "clusters.terminating": Rows(interactive & (idle > 0)),
            "clusters.long_idle": Rows(interactive & (idle > fixed.LONG_IDLE_MINUTES)),
            "clusters.spot": Rows(spot),
            "clusters.current_node": Rows(
                has_any(lowered(F.col("worker_node_type")), fixed.CURRENT_INSTANCE_FAMILIES)
            ),
            "clusters.node_types": Top("node_type", 8),
        },
        keys={"node_type": F.coalesce(F.col("worker_node_type"), F.lit("unknown"))},
    )


@evidence("warehouses", "compute.warehouses")
def warehouses(run: Run) -> Pass:
    frame = _latest(
        run, "compute.warehouses", run.sources.frame("compute.warehouses"), "warehouse_id"
    )
    return Pass(
        frame,
        {
            "warehouses.total": Rows(),
            "warehouses.scaling": Rows(
                F.col("max_clusters") > F.coalesce("min_clusters", F.lit(1))
            ),
            "warehouses.stopping": Rows(F.col("auto_stop_minutes") > 0),
        },
    )


STORAGE = "storage.table_metrics_history"


@evidence("storage", STORAGE, scoped=True, unscoped=("storage.clones",))
def storage(run: Run) -> Pass:
    """Latest snapshot per table in scope, and recent clones of any table.

    Catalog and schema are fixed for a table id, so the scope holds for all its snapshots.
    """
    history = run.marked(run.sources.frame(STORAGE), "catalog_name", "schema_name")
    history = _narrow(STORAGE, history, IN_SCOPE)
    history = history.where(run.known(history, "snapshot_date"))
    recent = run.since(history, "snapshot_date", fixed.CLONE_WINDOW_DAYS)
    cloned = recent & F.col("clone_details").isNotNull() & F.col("table_id").isNotNull()
    frame = newest_and_counts(
        history,
        "table_id",
        "snapshot_date",
        run.alive(history, "table_dropped_time"),
        {"_clones": cloned},
        run.config.rank_before_live_filter,
        among=F.col(IN_SCOPE),
    )
    newest = F.col(IS_NEWEST)
    setting = lowered(F.col("predictive_optimization_enabled"))
    with_files = newest & (F.coalesce("active_files", F.lit(0)) > 0)
    file_bytes = F.when(with_files, F.try_divide("active_bytes", "active_files"))
    return Pass(
        frame,
        {
            "storage.tables": Rows(newest),
            "storage.automatic": Rows(newest & has_any(setting, ("enable", "inherit", "true"))),
            "storage.small": Rows(
                newest
                & F.coalesce("active_bytes", F.lit(0)).between(1, fixed.SMALL_TABLE_BYTES)
            ),
            "storage.with_files": Rows(with_files),
            "storage.healthy_files": Rows(file_bytes >= fixed.HEALTHY_FILE_BYTES),
            "storage.small_files": Rows(file_bytes < fixed.HEALTHY_FILE_BYTES),
            "storage.file_bytes": Mean(file_bytes),
            "storage.clones": Rows(F.col("_clones") > 0),
        },
    )
