"""Rules: interoperability and usability."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.fixed_values import COMPLETED, IN_PROGRESS, OPEN
from posture.functions.grading import (
    known,
    billed,
    listing,
    percent,
    percent_text,
    rounded,
    sentence,
    signal_count,
    signal_status,
    whole,
)
from posture.functions.text import has_any
from posture.plans.rules import Evidence, Verdict, question

TABLES = "information_schema.tables"


@question("IU-01-01")
def integration_patterns(e: Evidence) -> Verdict:
    connections, locations = e.n("connections.rows"), e.n("external_locations.rows")
    credentials, inline = e.n("storage_credentials.rows"), e.n("queries.inline_credentials")
    return Verdict(
        F.when(connections + locations == 0, OPEN)
        .when(inline == 0, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} connection(s), {} external location(s) and {} credential(s) are governed; {}"
            " statement(s) carry database URLs or cloud keys inline in {} days.",
            whole(connections), whole(locations), whole(credentials), whole(inline), e.days,
        ),
        {
            "connections": connections,
            "external_locations": locations,
            "storage_credentials": credentials,
            "adhoc_statements": inline,
        },
    )


@question("IU-01-02")
def ingestion_connectors(e: Evidence) -> Verdict:
    files, managed = e.n("queries.file_ingestion"), e.n("pipelines.ingestion_versions")
    federated, streams = e.n("connections.rows"), e.n("streams.rows")
    signals = (files, managed, federated, streams)
    return Verdict(
        signal_status(*signals),
        sentence(
            "{} way(s) to ingest natively: {} file-ingestion statement(s) in {} days, {}"
            " managed pipeline(s), {} federated connection(s), {} stream(s).",
            signal_count(*signals),
            whole(files), e.days, whole(managed), whole(federated), whole(streams),
        ),
        {
            "autoloader": files,
            "managed_ingestion": managed,
            "federation": federated,
            "zerobus": streams,
        },
    )


@question("IU-01-03", "query.history")
def partner_tools(e: Evidence) -> Verdict:
    mix = e.mix("queries.clients")
    listed = F.filter(mix, lambda p: has_any(F.lower(p["key"]), fixed.PARTNER_TOOLS))
    tools, every = e.n("queries.partners"), e.n("queries.client_queries")
    by_partners = e.n("queries.partner_queries")
    return Verdict(
        F.when(every == 0, OPEN).when(tools == 0, IN_PROGRESS).otherwise(COMPLETED),
        F.when(
            every == 0,
            f"No client applications were recorded in {e.config.lookback_days} days.",
        ).otherwise(
            sentence(
                "{} partner tool(s) sent {} of {} query/queries ({}) in {} days. Top clients:"
                " {}.",
                whole(tools), whole(by_partners), whole(every),
                percent_text(percent(by_partners, every) / 100),
                e.days, listing(F.slice(mix, 1, 6)),
            )
        ),
        {
            "partners": tools,
            "partner_queries": by_partners,
            "attributed_queries": every,
            "partner_tools": F.transform(listed, lambda p: p["key"]),
            "client_mix": F.map_from_entries(mix),
        },
    )


@question("IU-01-04")
def simple_workloads(e: Evidence) -> Verdict:
    pipelines, jobs = e.n("pipelines.versions"), e.n("jobs.total")
    large = e.n("tasks.large_jobs")
    total = pipelines + jobs
    return e.ratio(
        total - large,
        total,
        f"workloads stay within {fixed.MANY_TASKS} tasks",
        nothing="No pipelines or jobs, so complexity cannot be assessed.",
        extra=sentence(
            "{} declarative pipeline(s); {} job(s) are larger.", whole(pipelines), whole(large)
        ),
        metrics={"pipelines": pipelines, "jobs": jobs, "complex_jobs": large},
    )


@question("IU-02-01", TABLES, scoped=True)
def open_formats(e: Evidence) -> Verdict:
    closed, open_tables = e.mix("tables.closed_formats"), e.n("tables.open_table_format")
    return e.ratio(
        e.n("tables.open_format"),
        e.n("tables.base"),
        f"tables in {e.where} use an open format",
        extra=sentence(
            "{} of them use an open table format. Other formats: {}.",
            whole(open_tables),
            F.when(F.size(closed) == 0, "none").otherwise(listing(closed)),
        ),
        metrics={"open_table_formats": open_tables},
    )


@question("IU-02-02")
def data_sharing(e: Evidence) -> Verdict:
    shares = e.n("shares.rows")
    recipients = F.coalesce(e.inventory("recipients"), F.lit(0))
    shared, limited = e.n("shared_tables.rows"), e.n("ip_ranges.recipients")
    return Verdict(
        F.when((shares == 0) & (recipients == 0), OPEN)
        .when((shares > 0) & (shared > 0), COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} share(s), {} recipient(s), {} shared table reference(s); {} recipient(s) are"
            " limited by address.",
            whole(shares), whole(recipients), whole(shared), whole(limited),
        ),
        {
            "shares": shares,
            "recipients": recipients,
            "shared_tables": shared,
            "ip_restricted_recipients": limited,
        },
    )


@question("IU-02-03")
def open_learning_standards(e: Evidence) -> Verdict:
    runs, experiments = e.n("runs.total"), e.n("experiments.live")
    endpoints = e.n("served.endpoints")
    return Verdict(
        F.when((runs == 0) & (experiments == 0) & (endpoints == 0), OPEN)
        .when((runs > 0) | (experiments > 0), COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} experiment(s) and {} run(s) in {} days are tracked in the open format; {}"
            " endpoint(s) serve models.",
            whole(experiments), whole(runs), e.days, whole(endpoints),
        ),
        {"runs": runs, "experiments": experiments, "endpoints": endpoints},
    )


@question("IU-03-01")
def self_service(e: Evidence) -> Verdict:
    users, readers = e.n("queries.principals"), e.n("schema_grants.readers")
    policies = e.inventory("cluster_policies")
    enablers = signal_count(policies, readers)
    return Verdict(
        F.when(users == 0, OPEN).when(enablers >= 2, COMPLETED).otherwise(IN_PROGRESS),
        sentence(
            "{} principal(s) ran queries in {} days; enablers: {} compute policies, {}"
            " principal(s) with read grants on schemas.",
            whole(users), e.days, known(policies), whole(readers),
        ),
        {"active_principals": users, "policies": policies, "principals_with_grants": readers},
    )


@question("IU-03-02", "billing.usage")
def serverless_services(e: Evidence) -> Verdict:
    products = e.n("usage.serverless_products")
    return e.ratio(
        rounded(e.x("usage.serverless")),
        billed(e.x("usage.total")),
        "usage units ran on serverless services",
        nothing=f"No billed usage in {e.config.lookback_days} days.",
        extra=sentence("{} product area(s) use them.", whole(products)),
        metrics={
            "serverless_dbus": F.round(e.x("usage.serverless"), 2),
            "total_dbus": F.round(e.x("usage.total"), 2),
            "serverless_products": products,
        },
    )


@question("IU-03-03")
def compute_templates(e: Evidence) -> Verdict:
    policies = e.inventory("cluster_policies")
    by_presence = e.presence(policies, "compute policies to start from")
    if not e.readable("compute.clusters"):
        return Verdict(by_presence.status, by_presence.reason, {"policies": policies})
    total, templated = e.n("clusters.total"), e.n("clusters.with_policy")
    by_share = e.ratio(
        templated,
        total,
        "clusters were created from a policy",
        extra=sentence("Policies available: {}.", known(policies)),
        metrics={"policies": policies, "templated_clusters": templated},
    )
    return Verdict(
        F.when(total == 0, by_presence.status).otherwise(by_share.status),
        F.when(total == 0, by_presence.reason).otherwise(by_share.reason),
        by_share.metrics,
    )


@question("IU-03-04")
def assisted_work(e: Evidence) -> Verdict:
    assistant, functions = e.n("assistant.rows"), e.n("queries.ai_functions")
    rooms = e.n("queries.assistant_rooms")
    signals = (assistant, functions, rooms)
    return Verdict(
        signal_status(*signals),
        sentence(
            "{} of 3 kinds of assistance in use: {} assistant event(s), {} statement(s) with AI"
            " functions, {} natural-language query/queries in {} days.",
            signal_count(*signals), whole(assistant), whole(functions), whole(rooms), e.days,
        ),
        {
            "assistant_events": assistant,
            "ai_function_calls": functions,
            "genie_queries": rooms,
        },
    )


@question("IU-04-01", TABLES, scoped=True)
def product_ready_tables(e: Evidence) -> Verdict:
    certified = e.n("tags.certified")
    return e.ratio(
        e.n("tables.product_ready"),
        e.n("tables.base"),
        f"tables in {e.where} are described and owned",
        extra=sentence("{} table(s) carry a product or trust tag.", whole(certified)),
        metrics={"certified_tables": certified},
    )


@question("IU-04-02", scoped=True)
def shared_semantics(e: Evidence) -> Verdict:
    views, tables = e.n("tables.views"), e.n("tables.base")
    metric_views, functions = e.n("tables.metric_views"), e.n("routines.total")
    total = views + tables
    return e.ratio(
        F.least(views + metric_views + functions, total),
        total,
        f"assets in {e.where} are offered through views or functions",
        complete_at=fixed.LOW_BAR,
        nothing="No tables or views in scope.",
        extra=sentence(
            "{} view(s), {} metric view(s) and {} function(s) over {} table(s).",
            whole(views), whole(metric_views), whole(functions), whole(tables),
        ),
        metrics={
            "views": views,
            "metric_views": metric_views,
            "functions": functions,
            "tables": tables,
        },
    )


@question("IU-04-03", scoped=True)
def central_catalog(e: Evidence) -> Verdict:
    governed, legacy = e.n("tables.base"), e.n("tables.legacy_base")
    events = e.n("column_lineage.rows")
    return e.ratio(
        governed,
        governed + legacy,
        f"tables in {e.where} or the legacy metastore are in the central catalog",
        nothing="No tables in the catalog or the legacy metastore.",
        extra=sentence(
            "{} column lineage event(s) in {} days; {} legacy table(s).",
            whole(events), e.days, whole(legacy),
        ),
        metrics={
            "column_lineage_events": events,
            "hive_metastore_tables": legacy,
            "uc_tables": governed,
        },
    )
