"""Rules: reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.fixed_values import COMPLETED, IN_PROGRESS, OPEN
from posture.functions.grading import (
    billed,
    decimal,
    downgrade,
    listing,
    percent,
    percent_text,
    rounded,
    sentence,
    signal_count,
    signal_status,
    whole,
)
from posture.plans.rules import Evidence, Verdict, question

TABLES = "information_schema.tables"
COLUMNS = "information_schema.columns"
JOBS = "lakeflow.jobs"


@question("R-01-01", TABLES, scoped=True)
def transactional_formats(e: Evidence) -> Verdict:
    other = e.mix("tables.unsafe_formats")
    return e.ratio(
        e.n("tables.transactional"),
        e.n("tables.base"),
        f"tables in {e.where} use a transactional format",
        extra=sentence(
            "Other formats: {}.", F.when(F.size(other) == 0, "none").otherwise(listing(other))
        ),
    )


@question("R-01-02", "compute.clusters")
def managed_engine(e: Evidence) -> Verdict:
    clusters, jobs = e.n("clusters.total"), e.n("usage.serverless_jobs")
    return Verdict(
        F.when((clusters == 0) & (jobs == 0), OPEN).otherwise(COMPLETED),
        sentence(
            "{} cluster(s) and {} serverless job(s) ran on the managed engine in {} days.",
            whole(clusters), whole(jobs), e.days,
        ),
        {"clusters": clusters, "serverless_jobs": jobs},
    )


@question("R-01-03", TABLES, COLUMNS, scoped=True)
def rescued_records(e: Evidence) -> Verdict:
    rescued, quarantine = e.n("columns.rescued_any"), e.n("tables.quarantine")
    tables = e.n("tables.base")
    found = rescued + quarantine
    return Verdict(
        F.when(found == 0, OPEN).when(found < 3, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} table(s) keep a rescue column and {} table(s) hold rejected records, of {}"
            " table(s) in {}.",
            whole(rescued), whole(quarantine), whole(tables), F.lit(e.where),
        ),
        {
            "rescued_data_tables": rescued,
            "quarantine_tables": quarantine,
            "tables_scanned": tables,
        },
    )


@question("R-01-04", JOBS)
def timeouts_and_retries(e: Evidence) -> Verdict:
    limited, retried = e.n("jobs.with_timeout"), e.n("job_runs.retried_jobs")
    return e.ratio(
        limited,
        e.n("jobs.total"),
        "live jobs have a timeout",
        extra=sentence("{} job(s) were retried in {} days.", whole(retried), e.days),
        metrics={"jobs_with_timeout": limited, "jobs_with_retries": retried},
    )


@question("R-01-05", "serving.served_entities")
def model_serving(e: Evidence) -> Verdict:
    endpoints, entities = e.n("served.endpoints"), e.n("served.entities")
    calls = e.n("endpoint_calls.rows")
    return Verdict(
        F.when(endpoints == 0, OPEN).otherwise(COMPLETED),
        sentence(
            "{} managed endpoint(s) serve {} model(s), {} request(s) in {} days.",
            whole(endpoints), whole(entities), whole(calls), e.days,
        ),
        {"endpoints": endpoints, "entities": entities, "requests": calls},
    )


@question("R-01-06", "billing.usage")
def managed_services(e: Evidence) -> Verdict:
    return e.ratio(
        rounded(e.x("usage.serverless")),
        billed(e.x("usage.total")),
        "usage units ran on managed compute",
        nothing=f"No billed usage in {e.config.lookback_days} days.",
        metrics={
            "serverless_dbus": F.round(e.x("usage.serverless"), 2),
            "total_dbus": F.round(e.x("usage.total"), 2),
        },
    )


@question("R-02-01", TABLES, scoped=True)
def layered_storage(e: Evidence) -> Verdict:
    layers = {layer: e.n(f"tables.{layer}") for layer in fixed.LAYERS}
    n, schemas = signal_count(*layers.values()), e.n("tables.schemas")
    return Verdict(
        F.when(n == 0, OPEN).when(n < 3, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} of 3 layers show in names (bronze {}, silver {}, gold {}) among {} schema(s)"
            " in {}.",
            n, *(whole(c) for c in layers.values()), whole(schemas), F.lit(e.where),
        ),
        {**layers, "schemas": schemas},
    )


@question("R-02-02", TABLES, scoped=True)
def redundant_copies(e: Evidence) -> Verdict:
    total, suspects, views = e.n("tables.base"), e.n("tables.duplicates"), e.n("tables.views")
    return e.ratio(
        total - suspects,
        total,
        f"tables in {e.where} are no copies by name",
        extra=sentence("{} look like copies; {} view(s) exist.", whole(suspects), whole(views)),
        metrics={"suspect_duplicates": suspects, "views": views},
    )


@question("R-02-03", "access.audit", COLUMNS, scoped=True)
def managed_schemas(e: Evidence) -> Verdict:
    total, required = e.n("columns.total"), e.n("columns.not_null")
    changes = e.n("audit.altering")
    share = percent(required, total)
    return Verdict(
        F.when(total == 0, OPEN)
        .when(share >= fixed.NOT_NULL_PERCENT, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} of {} column(s) ({}) are declared NOT NULL; {} schema change(s) were audited in"
            " {} days.",
            whole(required), whole(total), percent_text(share / 100), whole(changes), e.days,
        ),
        {
            "not_null_columns": required,
            "total_columns": total,
            "alter_events": changes,
        },
    )


@question("R-02-04", TABLES, "information_schema.table_constraints", scoped=True)
def declared_constraints(e: Evidence) -> Verdict:
    kinds, pipelines = e.mix("constraints.kinds"), e.n("pipelines.versions")
    return e.ratio(
        e.n("constraints.tables"),
        e.n("tables.base"),
        f"tables in {e.where} declare a constraint",
        extra=sentence(
            "Kinds: {}. {} declarative pipeline(s) can carry expectations.",
            F.when(F.size(kinds) == 0, "none").otherwise(listing(kinds)),
            whole(pipelines),
        ),
        metrics={
            "constraint_mix": F.map_from_entries(kinds),
            "declarative_pipelines": pipelines,
        },
    )


@question("R-02-05", "mlflow.runs_latest", caveat=True)
def data_centric_learning(e: Evidence) -> Verdict:
    runs, features = e.n("runs.total"), e.n("tags.features")
    emitters = e.n("lineage.emitters")
    return Verdict(
        F.when(runs == 0, OPEN).when(features > 0, COMPLETED).otherwise(IN_PROGRESS),
        sentence(
            "{} run(s) in {} days, {} table(s) tagged as features, {} lineage source(s).",
            whole(runs), e.days, whole(features), whole(emitters),
        ),
        {"runs": runs, "feature_tables": features, "lineage_entities": emitters},
    )


@question("R-03-01", "compute.clusters")
def cluster_autoscaling(e: Evidence) -> Verdict:
    total, scaling = e.n("clusters.total"), e.n("clusters.autoscaling")
    jobs = e.n("usage.serverless_jobs")
    by_share = e.ratio(
        scaling, total, "recent clusters scale automatically", metrics={"serverless_jobs": jobs}
    )
    return Verdict(
        F.when((total == 0) & (jobs > 0), COMPLETED).otherwise(by_share.status),
        F.concat(
            by_share.reason,
            sentence(" {} job(s) run on serverless compute.", whole(jobs)),
        ),
        by_share.metrics,
    )


@question("R-03-02", "compute.warehouses")
def warehouse_autoscaling(e: Evidence) -> Verdict:
    return e.ratio(
        e.n("warehouses.scaling"),
        e.n("warehouses.total"),
        "warehouses can scale out",
        nothing="No warehouses were found that could scale.",
    )


@question("R-04-01", TABLES, scoped=True)
def streaming_recovery(e: Evidence) -> Verdict:
    pipelines, tables = e.n("pipelines.continuous_versions"), e.n("tables.streaming")
    statements = e.n("queries.streaming")
    return Verdict(
        F.when(pipelines + tables + statements == 0, OPEN)
        .when((pipelines > 0) | (tables > 0), COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} continuous pipeline(s), {} streaming table(s) and {} streaming statement(s) in"
            " {} days.",
            whole(pipelines), whole(tables), whole(statements), e.days,
        ),
        {
            "pipelines": pipelines,
            "streaming_tables": tables,
            "streaming_statements": statements,
        },
    )


@question("R-04-02", TABLES, scoped=True)
def time_travel(e: Evidence) -> Verdict:
    used, kept = e.n("queries.time_travel"), e.n("catalogs.with_retention")
    verdict = e.ratio(
        e.n("tables.delta"),
        e.n("tables.base"),
        f"tables in {e.where} can be read as of an earlier time",
        metrics={"time_travel_statements": used, "catalogs_with_retention": kept},
    )
    return Verdict(
        downgrade(verdict.status, used == 0),
        F.concat(
            verdict.reason,
            sentence(
                " {} time-travel or restore statement(s) in {} days; {} catalog(s) set a"
                " retention.{}",
                whole(used), e.days, whole(kept),
                F.when(
                    (verdict.status == COMPLETED) & (used == 0),
                    " Held at in-progress: never exercised.",
                ).otherwise(""),
            ),
        ),
        verdict.metrics,
    )


@question("R-04-03", JOBS)
def recoverable_orchestration(e: Evidence) -> Verdict:
    jobs, dependent = e.n("jobs.total"), e.n("tasks.dependent_jobs")
    repairs = e.n("job_runs.repairs")
    return e.ratio(
        dependent,
        jobs,
        "live jobs declare task order",
        extra=sentence("{} repair or retry run(s) in {} days.", whole(repairs), e.days),
        metrics={"jobs": jobs, "multi_task_jobs": dependent, "repair_runs": repairs},
    )


@question("R-04-04")
def disaster_recovery(e: Evidence) -> Verdict:
    replicas, clones = e.n("replication.rows"), e.n("storage.clones")
    shares, workspaces = e.n("shares.rows"), e.n("workspaces.total")
    return Verdict(
        F.when((replicas == 0) & (clones == 0), OPEN)
        .when(replicas == 0, IN_PROGRESS)
        .otherwise(COMPLETED),
        sentence(
            "{} replication record(s), {} table(s) cloned in {} days, {} share(s), {}"
            " workspace(s).",
            whole(replicas), whole(clones), F.lit(str(fixed.CLONE_WINDOW_DAYS)),
            whole(shares), whole(workspaces),
        ),
        {
            "replication_states": replicas,
            "clones": clones,
            "shares": shares,
            "workspaces": workspaces,
        },
    )


@question("R-05-01", "lakeflow.job_run_timeline", JOBS)
def platform_events(e: Evidence) -> Verdict:
    runs, failed = e.n("job_runs.ended"), e.n("job_runs.failed")
    rules, success = e.n("jobs.with_health_rules"), percent(e.n("job_runs.succeeded"), runs)
    verdict = e.ratio(
        rules,
        e.n("jobs.total"),
        "live jobs have health rules",
        metrics={
            "runs": runs,
            "failed": failed,
            "success_rate_pct": F.round(success, 2),
            "jobs_with_health_rules": rules,
        },
    )
    return Verdict(
        F.when(runs == 0, OPEN).otherwise(verdict.status),
        F.when(runs == 0, f"No job runs were recorded in {e.config.lookback_days} days.").otherwise(
            F.concat(
                verdict.reason,
                sentence(
                    " {} run(s), {}% succeeded, {} failed.",
                    whole(runs), decimal(success), whole(failed),
                ),
            )
        ),
        verdict.metrics,
    )


@question("R-05-02")
def cloud_events(e: Evidence) -> Verdict:
    nodes, instances = e.n("nodes.last_week"), e.n("instances.rows")
    network = e.n("outbound.rows")
    signals = (nodes, instances, network)
    return Verdict(
        signal_status(*signals),
        sentence(
            "{} of 3 infrastructure streams hold rows: {} node metric(s), {} instance event(s),"
            " {} network event(s).",
            signal_count(*signals), whole(nodes), whole(instances), whole(network),
        ),
        {
            "node_timeline_rows": nodes,
            "instance_events": instances,
            "outbound_network_events": network,
        },
    )
