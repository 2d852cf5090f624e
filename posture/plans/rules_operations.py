"""Rules: operational excellence."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.fixed_values import COMPLETED, IN_PROGRESS, OPEN
from posture.functions.grading import (
    known,
    decimal,
    downgrade,
    percent,
    sentence,
    signal_count,
    signal_status,
    whole,
)
from posture.plans.rules import Evidence, Verdict, manual, open_because, question

JOBS = "lakeflow.jobs"
CATALOGS = "information_schema.catalogs"

manual(
    "OE-01-01",
    "how a team is set up and who is on call is not recorded in the platform.",
    "the owner of platform operations, the rota and the escalation path.",
)


@question("OE-01-02")
def source_control(e: Evidence) -> Verdict:
    repos, credentials = e.inventory("repos"), e.inventory("git_credentials")
    jobs, deployed = e.n("jobs.versions"), e.n("jobs.deployed")
    nothing = (
        (F.coalesce(repos, F.lit(0)) == 0)
        & (F.coalesce(credentials, F.lit(0)) == 0)
        & (deployed == 0)
    )
    by_share = e.ratio(
        deployed,
        jobs,
        "live jobs are deployed from source control",
        metrics={"repos": repos, "git_credentials": credentials, "git_backed_jobs": deployed},
    )
    return Verdict(
        F.when(nothing, OPEN).when(jobs > 0, by_share.status).otherwise(IN_PROGRESS),
        F.when(nothing, "No repositories, credentials or deployed jobs were found.").otherwise(
            F.concat(
                by_share.reason,
                sentence(
                    " Repositories: {}; credentials: {}.", known(repos), known(credentials)
                ),
            )
        ),
        by_share.metrics,
    )


@question("OE-01-03", JOBS)
def release_process(e: Evidence) -> Verdict:
    deployed = e.n("jobs.deployed")
    return e.ratio(
        deployed,
        e.n("jobs.versions"),
        "live jobs carry a deployment record, the trace of a release pipeline",
        metrics={"bundle_deployed_jobs": deployed},
    )


@question("OE-01-04")
def model_operations(e: Evidence) -> Verdict:
    models = F.coalesce(e.inventory("registered_models"), F.lit(0))
    experiments, runs = e.n("experiments.live"), e.n("runs.total")
    return Verdict(
        F.when((models == 0) & (experiments == 0) & (runs == 0), OPEN)
        .when(models == 0, IN_PROGRESS)
        .otherwise(COMPLETED),
        sentence(
            "{} registered model(s), {} experiment(s) and {} run(s) in {} days.",
            whole(models), whole(experiments), whole(runs), e.days,
        ),
        {"uc_models": models, "experiments": experiments, "runs": runs},
    )


@question("OE-01-05", CATALOGS, scoped=True, caveat=False)
def environment_isolation(e: Evidence) -> Verdict:
    prod, dev, test = (e.n(f"catalogs.{t}") for t in fixed.ENVIRONMENT_TIERS)
    tiers = signal_count(prod, dev, test)
    total, workspaces = e.n("catalogs.total"), e.n("workspaces.total")
    return Verdict(
        F.when(tiers == 0, OPEN)
        .when((prod > 0) & (tiers >= 2), COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} of 3 tiers show in catalog names (production {}, development {}, test {})"
            " across {} catalog(s) and {} workspace(s).",
            tiers, whole(prod), whole(dev), whole(test), whole(total), whole(workspaces),
        ),
        {
            "prod": prod,
            "dev": dev,
            "test": test,
            "catalogs": total,
            "workspaces": workspaces,
        },
    )


@question("OE-01-06", "serving.served_entities")
def model_providers(e: Evidence) -> Verdict:
    endpoints, providers = e.n("served.endpoints"), e.n("served.providers")
    external, foundation = e.n("served.external"), e.n("served.foundation")
    calls = e.n("gateway.rows")
    return Verdict(
        F.when(endpoints == 0, OPEN)
        .when(external + foundation == 0, IN_PROGRESS)
        .otherwise(COMPLETED),
        sentence(
            "{} endpoint(s) with {} foundation and {} external model(s) of {} provider(s); {}"
            " gateway request(s) in {} days.",
            whole(endpoints), whole(foundation), whole(external), whole(providers),
            whole(calls), e.days,
        ),
        {
            "endpoints": endpoints,
            "external": external,
            "foundation": foundation,
            "providers": providers,
            "gateway_requests": calls,
        },
    )


@question("OE-01-07", CATALOGS, scoped=True, caveat=False)
def catalog_strategy(e: Evidence) -> Verdict:
    total, owned = e.n("catalogs.total"), e.n("catalogs.owned")
    legacy = e.n("tables.legacy")
    return e.ratio(
        e.n("catalogs.documented"),
        total,
        "own catalogs have a description",
        extra=sentence(
            "{} have an owner; {} table(s) are in the legacy metastore.",
            whole(owned), whole(legacy),
        ),
        metrics={"catalogs": total, "owned": owned, "hive_metastore_tables": legacy},
    )


@question("OE-01-08")
def output_comparison(e: Evidence) -> Verdict:
    runs, scores = e.n("runs.evaluating"), e.n("run_metrics.comparison")
    return Verdict(
        F.when((runs == 0) & (scores == 0), OPEN)
        .when(scores > 0, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} evaluation run(s) and {} quality score(s) in {} days.",
            whole(runs), whole(scores), e.days,
        ),
        {"evaluation_runs": runs, "quality_metrics": scores},
    )


manual(
    "OE-01-09",
    "whether training data represents the problem is a judgement of its makers.",
    "the list of training sources, how coverage was checked and how bias is reviewed.",
)


@question("OE-02-01", JOBS)
def infrastructure_as_code(e: Evidence) -> Verdict:
    deployed, calls = e.n("jobs.deployed"), e.n("audit.code_tools")
    return e.ratio(
        deployed,
        e.n("jobs.versions"),
        "live jobs are declared as code",
        extra=sentence(
            "{} audited call(s) came from infrastructure tools in {} days.",
            whole(calls), e.days,
        ),
        metrics={"iac_jobs": deployed, "terraform_api_calls": calls},
    )


@question("OE-02-02", "compute.clusters")
def compute_standards(e: Evidence) -> Verdict:
    policies = e.inventory("cluster_policies")
    total, governed = e.n("clusters.total"), e.n("clusters.with_policy")
    by_presence = e.presence(policies, "compute policies")
    by_share = e.ratio(
        governed,
        total,
        "recent clusters follow a policy",
        extra=sentence("Policies defined: {}.", known(policies)),
        metrics={"policies": policies, "governed_clusters": governed},
    )
    return Verdict(
        F.when(total == 0, by_presence.status).otherwise(by_share.status),
        F.when(total == 0, by_presence.reason).otherwise(by_share.reason),
        by_share.metrics,
    )


@question("OE-02-03", JOBS)
def job_triggers(e: Evidence) -> Verdict:
    triggered, paused = e.n("jobs.triggered"), e.n("jobs.paused")
    return e.ratio(
        triggered,
        e.n("jobs.versions"),
        "live jobs start on a trigger",
        extra=sentence("{} are paused.", whole(paused)),
        metrics={"triggered_jobs": triggered, "paused_jobs": paused},
    )


@question("OE-02-04", scoped=True)
def event_driven_ingestion(e: Evidence) -> Verdict:
    arrivals, statements = e.n("jobs.file_arrival"), e.n("queries.file_ingestion")
    rescued, managed = e.n("columns.rescued"), e.n("pipelines.ingestion_versions")
    any_signal = signal_count(arrivals, statements, rescued, managed) > 0
    return Verdict(
        F.when(~any_signal, OPEN)
        .when((arrivals > 0) | (statements > 0), COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} job(s) start on file arrival, {} file-ingestion statement(s) in {} days, {}"
            " table(s) with a rescue column, {} managed pipeline(s).",
            whole(arrivals), whole(statements), e.days, whole(rescued), whole(managed),
        ),
        {
            "file_arrival_jobs": arrivals,
            "autoloader_statements": statements,
            "rescued_data_tables": rescued,
            "ingestion_pipelines": managed,
        },
    )


@question("OE-02-05")
def pipeline_frameworks(e: Evidence) -> Verdict:
    pipelines, jobs = e.n("pipelines.versions"), e.n("jobs.total")
    return e.ratio(
        pipelines,
        pipelines + jobs,
        "workloads are declarative pipelines",
        complete_at=fixed.LOW_BAR,
        nothing="No pipelines or jobs were found.",
        metrics={"pipelines": pipelines, "jobs": jobs},
    )


@question("OE-02-06")
def deployed_learning_code(e: Evidence) -> Verdict:
    models = F.coalesce(e.inventory("registered_models"), F.lit(0))
    jobs = e.n("jobs.learning")
    return Verdict(
        F.when(models == 0, OPEN).when(jobs == 0, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} registered model(s) and {} job(s) that train or score by name.",
            whole(models), whole(jobs),
        ),
        {"uc_models": models, "ml_jobs": jobs},
    )


@question("OE-02-07")
def model_registry(e: Evidence) -> Verdict:
    models = e.inventory("registered_models")
    served = e.n("served.registered")
    return Verdict(
        F.when(F.coalesce(models, F.lit(0)) == 0, OPEN).otherwise(COMPLETED),
        F.when(models.isNull(), "The model inventory was not taken.").otherwise(
            sentence(
                "{} model(s) are registered, {} of them distinct by name are served.",
                whole(models), whole(served),
            )
        ),
        {"uc_models": models, "served_models": served},
    )


@question("OE-02-08", "mlflow.runs_latest")
def run_tracking(e: Evidence) -> Verdict:
    runs, scored = e.n("runs.total"), e.n("runs.with_metrics")
    parameters = e.n("runs.with_parameters")
    return e.ratio(
        scored,
        runs,
        "tracked runs logged metrics",
        nothing=f"No tracked runs in {e.config.lookback_days} days.",
        extra=sentence("{} logged parameters.", whole(parameters)),
        metrics={"runs": runs, "runs_with_metrics": scored, "runs_with_params": parameters},
    )


@question("OE-02-09", JOBS)
def shared_orchestration(e: Evidence) -> Verdict:
    learning, jobs, runs = e.n("jobs.learning"), e.n("jobs.total"), e.n("runs.total")
    return Verdict(
        F.when((runs == 0) & (learning == 0), OPEN)
        .when(learning == 0, IN_PROGRESS)
        .otherwise(COMPLETED),
        sentence(
            "{} of {} job(s) do machine learning by name; {} run(s) in {} days.",
            whole(learning), whole(jobs), whole(runs), e.days,
        ),
        {"ml_jobs": learning, "total_jobs": jobs, "runs": runs},
    )


@question("OE-02-10")
def declarative_management(e: Evidence) -> Verdict:
    pipelines, serverless = e.n("pipelines.total"), e.n("pipelines.serverless")
    dependent, jobs = e.n("tasks.dependent_jobs"), e.n("jobs.total")
    total = pipelines + jobs
    return e.ratio(
        F.least(pipelines + dependent, total),
        total,
        "workloads are pipelines or jobs with declared task order",
        nothing="No pipelines or jobs were found.",
        extra=sentence(
            "{} pipeline(s), {} serverless; {} of {} job(s) declare task order.",
            whole(pipelines), whole(serverless), whole(dependent), whole(jobs),
        ),
        metrics={
            "pipelines": pipelines,
            "serverless_pipelines": serverless,
            "multi_task_jobs": dependent,
            "jobs": jobs,
        },
    )


@question("OE-02-11")
def output_evaluation(e: Evidence) -> Verdict:
    jobs, scores = e.n("jobs.evaluation"), e.n("run_metrics.quality")
    endpoints = e.n("served.language_endpoints")
    return Verdict(
        F.when((endpoints == 0) & (jobs == 0) & (scores == 0), OPEN)
        .when(jobs == 0, IN_PROGRESS)
        .otherwise(COMPLETED),
        sentence(
            "{} evaluation job(s) and {} quality score(s) in {} days for {} language-model"
            " endpoint(s).",
            whole(jobs), whole(scores), e.days, whole(endpoints),
        ),
        {"eval_jobs": jobs, "quality_metrics": scores, "llm_endpoints": endpoints},
    )


@question("OE-03-01")
def monitoring(e: Evidence) -> Verdict:
    found = [label for source, label in fixed.CORE_TELEMETRY if e.readable(source)]
    if not found:
        return open_because("No core telemetry is readable, so there is nothing to monitor.")
    consumers = e.n("queries.system_principals")
    verdict = e.ratio(
        F.lit(len(found)).cast("long"),
        F.lit(len(fixed.CORE_TELEMETRY)).cast("long"),
        "core telemetry tables are readable",
        extra=sentence(
            "Readable: {}. {} principal(s) queried telemetry in {} days.",
            F.lit(", ".join(found)), whole(consumers), e.days,
        ),
        metrics={"system_table_consumers": consumers},
    )
    return Verdict(
        downgrade(verdict.status, consumers == 0),
        F.concat(
            verdict.reason,
            F.when(
                (verdict.status == COMPLETED) & (consumers == 0),
                " Held at in-progress: nobody reads it.",
            ).otherwise(""),
        ),
        verdict.metrics,
    )


@question("OE-03-02")
def monitoring_tools(e: Evidence) -> Verdict:
    dashboards, alerts = e.n("queries.dashboards"), e.n("queries.alerts")
    agents = e.n("audit.observers")
    signals = (dashboards, alerts, agents)
    return Verdict(
        signal_status(*signals),
        sentence(
            "{} of 3 channels in use: {} dashboard(s) on telemetry, {} alert(s), {} external"
            " monitoring agent(s) in {} days.",
            signal_count(*signals), whole(dashboards), whole(alerts), whole(agents), e.days,
        ),
        {"dashboards": dashboards, "alerts": alerts, "external_agents": agents},
    )


manual(
    "OE-03-03",
    "runbooks and escalation paths leave no trace in the platform.",
    "the incident runbook, the severity levels, the rota and the last review.",
)


@question("OE-03-04")
def event_responses(e: Evidence) -> Verdict:
    alerts, rules = e.n("queries.alerts"), e.n("jobs.with_health_rules")
    driven, jobs = e.n("jobs.event_driven"), e.n("jobs.versions")
    signals = (alerts, rules, driven)
    return Verdict(
        signal_status(*signals),
        sentence(
            "{} of 3 mechanisms in place: {} alert(s), {} of {} job(s) with health rules, {}"
            " job(s) started by an event.",
            signal_count(*signals), whole(alerts), whole(rules), whole(jobs), whole(driven),
        ),
        {
            "alerts": alerts,
            "jobs_with_health_rules": rules,
            "event_driven_jobs": driven,
            "jobs": jobs,
        },
    )


@question("OE-04-01")
def quota_pressure(e: Evidence) -> Verdict:
    sources = ("access.audit", "query.history", "compute.warehouse_events")
    readable = sum(e.readable(s) for s in sources)
    if not readable:
        return open_because("No source that would show quota pressure is readable.")
    throttled, queued = e.n("audit.throttled"), e.n("queries.queued")
    failures = e.n("warehouse_events.failed")
    calm = throttled + queued + failures == 0
    return Verdict(
        F.when(calm, COMPLETED).otherwise(IN_PROGRESS),
        sentence(
            "{} throttled call(s), {} queued query/queries and {} failed scale-up(s) in {} days"
            " across {} of 3 readable sources.",
            whole(throttled), whole(queued), whole(failures), e.days, F.lit(readable),
        ),
        {
            "throttle_events": throttled,
            "queued_queries": queued,
            "warehouse_failures": failures,
            "readable_sources": F.lit(readable).cast("long"),
        },
    )


@question("OE-04-02", "billing.usage")
def capacity_planning(e: Evidence) -> Verdict:
    days, queries = e.n("usage.trend_days"), e.n("queries.trend")
    recent, prior = e.x("usage.last_period"), e.x("usage.prior_period")
    growth = percent(recent - prior, prior)
    return Verdict(
        F.when(days == 0, OPEN).when(queries == 0, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} day(s) of usage; change against the {} days before: {}; {} trend query/queries"
            " on billing.",
            whole(days),
            F.lit(str(fixed.TREND_DAYS)),
            F.when(prior > 0, F.concat(decimal(growth), F.lit("%"))).otherwise("not known"),
            whole(queries),
        ),
        {
            "usage_days": days,
            "recent_dbus": F.round(recent, 2),
            "prior_dbus": F.round(prior, 2),
            "forecast_queries": queries,
        },
    )
