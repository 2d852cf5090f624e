"""Rules: cost optimization."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.fixed_values import COMPLETED, IN_PROGRESS, OPEN
from posture.functions.grading import (
    known,
    billed,
    decimal,
    listing,
    percent,
    percent_text,
    rounded,
    sentence,
    whole,
)
from posture.functions.text import has_any
from posture.plans.rules import Evidence, Verdict, open_because, question

USAGE = "billing.usage"
CLUSTERS = "compute.clusters"


def _no_usage(e: Evidence) -> str:
    return f"No billed usage in {e.config.lookback_days} days."


def _completed_without_clusters(verdict: Verdict, total) -> Verdict:
    """Nothing to configure is the good outcome here."""
    return Verdict(
        F.when(total == 0, COMPLETED).otherwise(verdict.status), verdict.reason, verdict.metrics
    )


@question("CO-01-01", "information_schema.tables", scoped=True)
def optimized_formats(e: Evidence) -> Verdict:
    return e.ratio(
        e.n("tables.transactional"),
        e.n("tables.base"),
        f"tables in {e.where} use a format that skips files",
    )


@question("CO-01-02", USAGE)
def job_compute(e: Evidence) -> Verdict:
    total, interactive = e.x("usage.non_sql"), e.x("usage.all_purpose")
    return e.ratio(
        rounded(total - interactive),
        billed(total),
        "usage units outside SQL ran on job or serverless compute",
        nothing=f"No usage outside SQL in {e.config.lookback_days} days.",
        extra=sentence(
            "All-purpose compute took {} ({}).",
            whole(interactive), percent_text(percent(interactive, total) / 100),
        ),
        metrics={
            "all_purpose_dbus": F.round(interactive, 2),
            "total_dbus": F.round(total, 2),
        },
    )


@question("CO-01-03", "query.history")
def warehouse_selects(e: Evidence) -> Verdict:
    return e.ratio(
        e.n("queries.warehouse_selects"),
        e.n("queries.selects"),
        "SELECT statements ran on a warehouse",
    )


@question("CO-01-04", CLUSTERS)
def current_runtimes(e: Evidence) -> Verdict:
    total, oldest = e.n("clusters.total"), e.value("clusters.oldest_major").cast("long")
    verdict = e.ratio(
        e.n("clusters.current_runtime"),
        total,
        f"recent clusters run version {fixed.CURRENT_RUNTIME_MAJOR} or newer",
        nothing="No clusters: serverless compute keeps its runtime current.",
        extra=F.when(oldest.isNull(), "").otherwise(
            sentence("The oldest version is {}.", oldest)
        ),
        metrics={
            "oldest_dbr_major": oldest,
            "threshold_major": F.lit(fixed.CURRENT_RUNTIME_MAJOR).cast("long"),
        },
    )
    return _completed_without_clusters(verdict, total)


@question("CO-01-05", USAGE)
def gpu_use(e: Evidence) -> Verdict:
    total, gpu, runs = e.x("usage.total"), e.x("usage.gpu"), e.n("runs.total")
    return Verdict(
        F.when(total <= 0, OPEN)
        .when((gpu == 0) | (runs > 0), COMPLETED)
        .otherwise(IN_PROGRESS),
        F.when(total <= 0, _no_usage(e)).otherwise(
            sentence(
                "GPU usage is {} of all ({} of {}); {} tracked run(s) in {} days.",
                percent_text(percent(gpu, total) / 100), whole(gpu), whole(total),
                whole(runs), e.days,
            )
        ),
        {
            "gpu_dbus": F.round(gpu, 2),
            "total_dbus": F.round(total, 2),
            "gpu_share_pct": F.round(percent(gpu, total), 2),
            "mlflow_runs": runs,
        },
    )


@question("CO-01-06", USAGE)
def serverless_workloads(e: Evidence) -> Verdict:
    return e.ratio(
        rounded(e.x("usage.serverless")),
        billed(e.x("usage.total")),
        "usage units ran on serverless compute",
        nothing=_no_usage(e),
        metrics={
            "serverless_dbus": F.round(e.x("usage.serverless"), 2),
            "total_dbus": F.round(e.x("usage.total"), 2),
        },
    )


@question("CO-01-07", CLUSTERS)
def instance_types(e: Evidence) -> Verdict:
    mix = e.mix("clusters.node_types")
    clusters = e.n("clusters.total")
    verdict = e.ratio(
        e.n("clusters.current_node"),
        clusters,
        "recent clusters use a current instance family",
        nothing="No clusters: serverless compute picks its instances.",
        extra=sentence("Instances: {}.", listing(mix)),
        metrics={"node_type_mix": F.map_from_entries(mix)},
    )
    return _completed_without_clusters(verdict, clusters)


@question("CO-01-08", "compute.node_timeline")
def cluster_size(e: Evidence) -> Verdict:
    clusters, cpu, memory = e.n("nodes.clusters"), e.x("nodes.cpu"), e.x("nodes.memory")
    low, high = fixed.CPU_BAND
    return Verdict(
        F.when(clusters == 0, OPEN)
        .when(cpu.between(low, high), COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} cluster(s) average {}% processor and {}% memory over {} days; the healthy"
            " processor band is {}.",
            whole(clusters), decimal(cpu), decimal(memory),
            F.lit(str(fixed.NODE_WINDOW_DAYS)), F.lit(f"{low}-{high}%"),
        ),
        {
            "clusters": clusters,
            "avg_cpu_pct": F.round(cpu, 2),
            "avg_mem_pct": F.round(memory, 2),
        },
    )


@question("CO-01-09", USAGE)
def query_engines(e: Evidence) -> Verdict:
    return e.ratio(
        rounded(e.x("usage.vectorized")),
        billed(e.x("usage.total")),
        "usage units ran on a vectorized engine",
        nothing=_no_usage(e),
        metrics={
            "vectorized_dbus": F.round(e.x("usage.vectorized"), 2),
            "total_dbus": F.round(e.x("usage.total"), 2),
        },
    )


@question("CO-02-01", CLUSTERS)
def elastic_compute(e: Evidence) -> Verdict:
    clusters, scaling = e.n("clusters.total"), e.n("clusters.autoscaling")
    warehouses, spreading = e.n("warehouses.total"), e.n("warehouses.scaling")
    return e.ratio(
        scaling + spreading,
        clusters + warehouses,
        "clusters and warehouses scale with load",
        nothing="No clusters or warehouses were found.",
        extra=sentence(
            "Clusters {} of {}, warehouses {} of {}.",
            whole(scaling), whole(clusters), whole(spreading), whole(warehouses),
        ),
        metrics={
            "clusters_autoscaling": scaling,
            "clusters_total": clusters,
            "warehouses_scaling": spreading,
            "warehouses_total": warehouses,
        },
    )


@question("CO-02-02", CLUSTERS)
def automatic_stop(e: Evidence) -> Verdict:
    clusters, stopping = e.n("clusters.interactive"), e.n("clusters.terminating")
    warehouses, resting = e.n("warehouses.total"), e.n("warehouses.stopping")
    slow = e.n("clusters.long_idle")
    return e.ratio(
        stopping + resting,
        clusters + warehouses,
        "interactive clusters and warehouses stop by themselves",
        nothing="No interactive clusters or warehouses were found.",
        extra=sentence(
            "Clusters {} of {}, {} of them after more than {} minutes; warehouses {} of {}.",
            whole(stopping), whole(clusters), whole(slow),
            F.lit(str(fixed.LONG_IDLE_MINUTES)), whole(resting), whole(warehouses),
        ),
        metrics={
            "clusters_with_autotermination": stopping,
            "clusters_over_120min": slow,
            "warehouses_with_autostop": resting,
        },
    )


@question("CO-02-03")
def compute_policies(e: Evidence) -> Verdict:
    policies = e.inventory("cluster_policies")
    defined = F.coalesce(policies > 0, F.lit(False))
    if not e.readable(CLUSTERS):
        return Verdict(
            F.when(defined, IN_PROGRESS).otherwise(OPEN),
            sentence("Clusters are not readable; compute policies: {}.", known(policies)),
            {"policies": policies},
        )
    total, governed = e.n("clusters.total"), e.n("clusters.with_policy")
    verdict = e.ratio(
        governed,
        total,
        "recent clusters follow a compute policy",
        nothing="No recent clusters.",
        extra=sentence("Policies defined: {}.", known(policies)),
        metrics={"policies": policies, "governed_clusters": governed},
    )
    return Verdict(
        F.when((total == 0) & defined, COMPLETED).otherwise(verdict.status),
        verdict.reason,
        verdict.metrics,
    )


@question("CO-03-01", USAGE)
def cost_monitoring(e: Evidence) -> Verdict:
    days, queries = e.n("usage.days"), e.n("queries.billing")
    people = e.n("queries.billing_principals")
    return Verdict(
        F.when(days == 0, OPEN).when(queries == 0, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} query/queries of {} principal(s) read billing in {} days; {} day(s) hold usage.",
            whole(queries), whole(people), e.days, whole(days),
        ),
        {"usage_days": days, "billing_queries": queries, "consumers": people},
    )


@question("CO-03-02", USAGE)
def tagged_usage(e: Evidence) -> Verdict:
    keys = e.mix("usage.tag_keys")
    return e.ratio(
        e.n("usage.tagged"),
        e.n("usage.rows"),
        "usage records carry tags",
        extra=sentence(
            "Tag keys: {}.", F.when(F.size(keys) == 0, "none").otherwise(listing(keys))
        ),
        metrics={"tag_keys": F.map_from_entries(keys)},
    )


@question("CO-03-03", USAGE)
def chargeback(e: Evidence) -> Verdict:
    dashboards = e.n("queries.billing_dashboards")
    priced = e.readable("billing.list_prices")
    return e.ratio(
        e.n("usage.chargeback"),
        e.n("usage.rows"),
        "usage records name who pays",
        extra=sentence(
            "{} dashboard(s) read billing; list prices are {}.",
            whole(dashboards), F.lit("available" if priced else "not available"),
        ),
        metrics={
            "billing_dashboards": dashboards,
            "list_prices_available": F.lit(priced),
        },
    )


@question("CO-03-04")
def cost_reports(e: Evidence) -> Verdict:
    dashboards = e.n("queries.billing_dashboards")
    alerts = e.n("queries.billing_alerts")
    return Verdict(
        F.when((dashboards == 0) & (alerts == 0), OPEN)
        .when(alerts > 0, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} dashboard(s) and {} alert(s) read billing in {} days.",
            whole(dashboards), whole(alerts), e.days,
        ),
        {"billing_dashboards": dashboards, "billing_alerts": alerts},
    )


@question("CO-03-05")
def sharing_costs(e: Evidence) -> Verdict:
    recipients = e.inventory("recipients")
    shares_known = e.readable("information_schema.shares")
    if not shares_known and not e.readable("workspace_inventory"):
        return open_because("Neither shares nor recipients are readable.")
    shares, receivers = e.n("shares.rows"), F.coalesce(recipients, F.lit(0))
    egress, copies = e.n("usage.egress"), e.n("materializations.rows")
    unknown = recipients.isNull() & F.lit(not shares_known)
    return Verdict(
        F.when(unknown, OPEN)
        .when((shares == 0) & (receivers == 0), COMPLETED)
        .when(egress == 0, IN_PROGRESS)
        .otherwise(COMPLETED),
        F.when(unknown, "Neither shares nor recipients are readable.").otherwise(
            sentence(
                "{} share(s) and {} recipient(s); {} usage record(s) for sharing or egress in {}"
                " days; {} materialization(s). Recipients {}.",
                whole(shares), whole(receivers), whole(egress), e.days, whole(copies),
                F.when(recipients.isNull(), "were not taken").otherwise("are known"),
            )
        ),
        {
            "shares": shares,
            "recipients": receivers,
            "egress_records": egress,
            "materializations": copies,
        },
    )


@question("CO-04-01", "lakeflow.pipelines")
def streaming_modes(e: Evidence) -> Verdict:
    total, continuous = e.n("pipelines.total"), e.n("pipelines.continuous")
    jobs, development = e.n("jobs.continuous"), e.n("pipelines.development")
    return e.ratio(
        total - continuous,
        total,
        "pipelines run when triggered",
        nothing=sentence("No pipelines; {} continuous job(s).", whole(jobs)),
        extra=sentence(
            "{} continuous pipeline(s), {} continuous job(s), {} pipeline(s) in development.",
            whole(continuous), whole(jobs), whole(development),
        ),
        metrics={
            "continuous_pipelines": continuous,
            "triggered_pipelines": total - continuous,
            "continuous_jobs": jobs,
            "development_pipelines": development,
        },
    )


@question("CO-04-02", CLUSTERS)
def spot_capacity(e: Evidence) -> Verdict:
    total, spot = e.n("clusters.total"), e.n("clusters.spot")
    verdict = e.ratio(
        spot,
        total,
        "recent clusters may use spare capacity",
        nothing="No clusters: serverless compute mixes capacity itself.",
        metrics={"spot_aware_clusters": spot},
    )
    return _completed_without_clusters(verdict, total)
