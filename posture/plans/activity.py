"""Evidence from activity logs: queries, audit, lineage, runs, node metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.functions.text import has_any, like, like_any, lowered, matches, named
from posture.operators.evidence import (
    Days,
    Distinct,
    Groups,
    Highest,
    Mean,
    Pass,
    Rows,
    Top,
    Total,
)
from posture.operators.run import Run
from posture.plans.passes import evidence

HISTORY = "query.history"


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


@evidence("queries", HISTORY)
def queries(run: Run) -> Pass:
    """One scan of the query log for every question about queries.

    Principals are the carrier; dashboards, alerts and clients are spread keys: a
    principal may use many clients, and groups by both would be nearly as many as rows.
    The statement text is read once and reduced to flags before the aggregate.
    """
    frame = run.recent(HISTORY, "start_time")
    if run.config.exclude_principals:
        outside = ~F.col("executed_by").isin(*run.config.exclude_principals)
        frame = frame.where(F.coalesce(outside, F.lit(True)))
    text = lowered(F.col("statement_text"))
    done = F.col("execution_status") == "FINISHED"
    read, shuffled = _or_zero("read_bytes"), _or_zero("shuffle_read_bytes")
    pruned, opened = _or_zero("pruned_files"), _or_zero("read_files")
    spilled = _or_zero("spilled_local_bytes") > 0
    queued = _or_zero("waiting_at_capacity_duration_ms") > 0
    # Most statements do not name telemetry at all; one search rules them out.
    on_system = like(text, fixed.SYSTEM_TEXT)
    on_billing_schema = on_system & like(text, fixed.BILLING_SCHEMA_TEXT)
    on_billing = on_billing_schema & like(text, fixed.BILLING_TEXT)
    client = F.col("client_application")
    features = {
        "on_system": on_system,
        "browsing": on_system & like(text, fixed.SCHEMA_BROWSING_TEXT),
        "on_billing_schema": on_billing_schema,
        "on_billing": on_billing,
        "on_lineage": on_system & like(text, fixed.LINEAGE_TEXT),
        "on_audit": on_system & like(text, fixed.AUDIT_TEXT),
        "on_history": on_system & like(text, fixed.HISTORY_TEXT),
        "trend": on_billing & (has_any(text, fixed.TREND_WORDS) | text.contains("group by")),
        "inline_credentials": (
            matches(text, fixed.INLINE_URL, "jdbc:") | like_any(text, fixed.INLINE_KEYS)
        ),
        "file_ingestion": like_any(text, fixed.FILE_INGESTION_TEXT),
        "ai_functions": matches(text, fixed.AI_FUNCTIONS, "ai_"),
        "streaming": like_any(text, fixed.STREAM_TEXT),
        "time_travel": like_any(text, fixed.TIME_TRAVEL_TEXT),
        "clustering": like_any(text, fixed.CLUSTERING_TEXT),
        "function_definitions": matches(text, fixed.FUNCTION_DEFINITION, "function", "_udf"),
        "compaction": matches(text, fixed.COMPACTION_STATEMENT, "optimize "),
        "statistics": matches(text, fixed.STATISTICS_STATEMENT, "analyze"),
        "joining": like(text, fixed.JOIN_TEXT),
        "partner": has_any(lowered(client), fixed.PARTNER_TOOLS),
    }
    on_system, on_billing_schema, on_billing, on_lineage, on_audit, joining, partner = (
        F.col(f"_{n}")
        for n in ("on_system", "on_billing_schema", "on_billing", "on_lineage", "on_audit",
                  "joining", "partner")
    )
    joins = done & joining
    select = F.col("statement_type") == "SELECT"
    with_file_counts = done & (pruned + opened > 0)
    named_client = client.isNotNull()

    def done_total(name: str) -> Total:
        return Total(F.when(done, _or_zero(name)))

    metrics = {
        "all": Rows(),
        "principals": Distinct("executed_by"),
        "lineage": Rows(on_lineage),
        "lineage_principals": Distinct("executed_by", on_lineage),
        "audit": Rows(on_audit),
        "audit_principals": Distinct("executed_by", on_audit),
        "billing": Rows(on_billing),
        "billing_principals": Distinct("executed_by", on_billing),
        "history": Rows(F.col("_on_history")),
        "system_principals": Distinct("executed_by", on_system & ~F.col("_browsing")),
        "assistant_rooms": Rows(F.col("query_source.genie_space_id").isNotNull()),
        "dashboards": Distinct("dashboard", on_system),
        "billing_dashboards": Distinct("dashboard", on_billing_schema),
        "alerts": Distinct("alert"),
        "billing_alerts": Distinct("alert", on_billing_schema),
        "queued": Rows(queued),
        "selects": Rows(select),
        "warehouse_selects": Rows(
            select & lowered(F.col("compute.type")).contains("warehouse")
        ),
        "finished": Rows(done),
        "finished_bytes": done_total("read_bytes"),
        "finished_pruned": done_total("pruned_files"),
        "finished_opened": done_total("read_files"),
        "finished_io_cache": Mean(F.when(done, _or_zero("read_io_cache_percent"))),
        "finished_from_cache": Rows(done & F.col("from_result_cache")),
        "with_file_counts": Rows(with_file_counts),
        "reading": Rows(done & (read > 0)),
        "reading_parallel": Rows(done & (read > 0) & (_or_zero("read_partitions") > 1)),
        "reading_partitions": Mean(F.when(done & (read > 0), _or_zero("read_partitions"))),
        "total_ms": done_total("total_duration_ms"),
        "execution_ms": done_total("execution_duration_ms"),
        "compile_ms": done_total("compilation_duration_ms"),
        "fetch_ms": done_total("result_fetch_duration_ms"),
        "compute_wait_ms": done_total("waiting_for_compute_duration_ms"),
        "capacity_wait_ms": done_total("waiting_at_capacity_duration_ms"),
        "cold_starts": Rows(
            done & (_or_zero("waiting_for_compute_duration_ms") > fixed.COLD_START_MS)
        ),
        "spilling": Rows(done & spilled),
        "shuffle_heavy": Rows(done & (shuffled > read) & (read > 0)),
        "finished_queued": Rows(done & queued),
        "joins": Rows(joins),
        "joins_spilling": Rows(joins & spilled),
        "joins_shuffled": Total(F.when(joins, shuffled)),
        "joins_read": Total(F.when(joins, read)),
        "days": Days(F.to_date("start_time"), *run.days()),
        # The most frequent clients are for the wording; the totals count all of them.
        "clients": Top("client", 10, named_client),
        "client_queries": Rows(named_client),
        "partner_queries": Rows(partner),
        "partners": Distinct("client", partner),
    }
    for name in (
        "trend", "inline_credentials", "file_ingestion", "ai_functions", "streaming",
        "time_travel", "clustering", "function_definitions", "compaction", "statistics",
    ):
        metrics[name] = Rows(F.col(f"_{name}"))
    return Pass(
        frame,
        {f"queries.{n}": m for n, m in metrics.items()},
        features={f"_{n}": c for n, c in features.items()},
        carrier=("executed_by",),
        spread={
            "dashboard": F.coalesce(
                F.col("query_source.dashboard_id"), F.col("query_source.legacy_dashboard_id")
            ),
            "alert": F.col("query_source.alert_id"),
            "client": client,
        },
    )


@evidence("audit", "access.audit")
def audit(run: Run) -> Pass:
    frame = run.recent("access.audit", "event_date")
    agent = lowered(F.col("user_agent"))
    action = F.col("action_name")
    altering = lowered(F.col("request_params.statement")).like(fixed.ALTER_TEXT) | (
        action == fixed.ALTER_ACTION
    )
    throttled = has_any(lowered(F.col("response.error_message")), fixed.THROTTLE_MESSAGES) | (
        F.col("response.status_code").try_cast("int") == fixed.THROTTLE_STATUS
    )
    return Pass(
        frame,
        {
            "audit.events": Rows(),
            "audit.days": Distinct("event_date"),
            "audit.last_day": Highest(F.unix_date(F.col("event_date"))),
            "audit.actions": Distinct("action_name"),
            "audit.code_tools": Rows(has_any(agent, fixed.CODE_TOOL_AGENTS)),
            "audit.observers": Distinct("observer", has_any(agent, fixed.OBSERVABILITY_AGENTS)),
            "audit.throttled": Rows(throttled),
            "audit.altering": Rows(
                named(F.col("service_name"), run.config.schema_services) & altering
            ),
        },
        carrier=("event_date", "action_name"),
        spread={"observer": F.col("user_agent")},
    )


@evidence("lineage", "access.table_lineage")
def lineage(run: Run) -> Pass:
    frame = run.recent("access.table_lineage", "event_date")
    source, target = F.col("source_table_catalog"), F.col("target_table_catalog")
    on_lineage = (
        (F.lower(F.col("source_table_schema")) == "access")
        & F.lower(F.col("source_table_name")).contains("lineage")
        & F.col("target_table_name").isNotNull()
    )
    return Pass(
        frame,
        {
            "lineage.derived_tables": Distinct("target", on_lineage),
            "lineage.legacy_events": Rows(
                (F.lower(source) == fixed.LEGACY_CATALOG)
                | (F.lower(target) == fixed.LEGACY_CATALOG)
            ),
            "lineage.emitters": Distinct(
                "entity_id", lowered(F.col("entity_type")).isin(*fixed.LINEAGE_EMITTERS)
            ),
        },
        carrier=("entity_id",),
        spread={
            "target": F.concat_ws(
                ".", "target_table_catalog", "target_table_schema", "target_table_name"
            )
        },
    )


@evidence("job_runs", "lakeflow.job_run_timeline")
def job_runs(run: Run) -> Pass:
    frame = run.recent("lakeflow.job_run_timeline", "period_start_time")
    state, kind = F.col("result_state"), lowered(F.col("run_type"))
    ended = state.isNotNull()
    return Pass(
        frame,
        {
            "job_runs.ended": Rows(ended),
            "job_runs.succeeded": Rows(state == "SUCCEEDED"),
            "job_runs.failed": Rows(state.isin(*fixed.FAILED_RUN_STATES)),
            "job_runs.jobs": Groups(ended),
            "job_runs.run_seconds": Mean(F.when(ended, _or_zero("run_duration_seconds"))),
            "job_runs.queue_seconds": Mean(F.when(ended, _or_zero("queue_duration_seconds"))),
            "job_runs.retried_jobs": Groups(kind.contains("retry")),
            "job_runs.repairs": Rows(kind.contains("repair") | kind.contains("retry")),
        },
        carrier=("job_id",),
    )


@evidence("nodes", "compute.node_timeline")
def nodes(run: Run) -> Pass:
    source = "compute.node_timeline"
    frame = run.recent(source, "start_time", fixed.NODE_WINDOW_DAYS)
    return Pass(
        frame,
        {
            "nodes.clusters": Groups(),
            "nodes.cpu": Mean(F.col("cpu_user_percent") + F.col("cpu_system_percent")),
            "nodes.memory": Mean(F.col("mem_used_percent")),
            "nodes.io_wait": Mean(_or_zero("cpu_wait_percent")),
            "nodes.swap": Mean(_or_zero("mem_swap_percent")),
            "nodes.last_week": Rows(run.since(frame, "start_time", fixed.NODE_EVENTS_DAYS)),
        },
        carrier=("cluster_id",),
    )


def _recent_rows(name: str, source: str, column: str):
    @evidence(name, source)
    def count_recent(run: Run) -> Pass:
        return Pass(run.recent(source, column), {f"{name}.rows": Rows()})

    return count_recent


_recent_rows("column_lineage", "access.column_lineage", "event_date")
_recent_rows("assistant", "access.assistant_events", "event_time")
_recent_rows("outbound", "access.outbound_network", "event_time")
_recent_rows("instances", "compute.instance_events", "event_time")
_recent_rows("endpoint_calls", "serving.endpoint_usage", "request_time")
_recent_rows("gateway", "ai_gateway.usage", "request_time")
_recent_rows("pipeline_updates", "lakeflow.pipeline_update_timeline", "update_start_time")


@evidence("warehouse_events", "compute.warehouse_events")
def warehouse_events(run: Run) -> Pass:
    failed = has_any(lowered(F.col("event_type")), fixed.SCALE_UP_FAILURES)
    return Pass(
        run.recent("compute.warehouse_events", "event_time"),
        {"warehouse_events.failed": Rows(failed)},
    )


@evidence("upkeep", "storage.predictive_optimization_operations_history")
def upkeep(run: Run) -> Pass:
    """Automatic table maintenance."""
    operation = lowered(F.col("operation_type"))
    return Pass(
        run.recent("storage.predictive_optimization_operations_history", "start_time"),
        {
            "upkeep.operations": Rows(),
            "upkeep.tables": Distinct("table_id"),
            "upkeep.statistics": Rows(has_any(operation, fixed.STATISTICS_OPERATIONS)),
        },
        carrier=("table_id",),
    )
