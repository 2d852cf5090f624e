"""SQL views of the derived telemetry for the comparison engine."""

from __future__ import annotations

import re

from posture.sources.star_telemetry import FLAT, flat_sql

RENAMED = {"ai_gateway.usage": "x_gateway"}
FIVE = "unnest([0, 1, 2, 3, 4])"

AS_OF_DAY, AS_OF_TIME = "DATE '2024-01-31'", "TIMESTAMP '2024-01-31 00:00:00'"
WINDOW_DAY = "DATE '2023-11-02'"
WINDOW_TIME = "TIMESTAMP '2023-11-02 00:00:00'"
DAY_30, DAY_60 = "DATE '2024-01-01'", "DATE '2023-12-02'"
TIME_30, TIME_7 = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-24 00:00:00'"


def view_name(source: str) -> str:
    return RENAMED.get(source, "x_" + source.split(".")[-1])


def _latest(view: str, key: str, at: str, live: str, extra: str = "TRUE") -> str:
    return (
        f"SELECT * FROM {view} WHERE {live} IS NULL AND {extra} QUALIFY row_number() OVER"
        f" (PARTITION BY {key} ORDER BY {at} DESC, version DESC) = 1"
    )


def in_scope(catalog: str = "table_catalog", schema: str = "table_schema") -> str:
    excluded = " OR ".join(
        f"lower({schema}) LIKE '{p}'"
        for p in ("%dev%", "%test%", "%sandbox%", "%tmp%", "%scratch%")
    )
    return (
        f"({catalog} IN (SELECT catalog_name FROM x_scope) AND NOT ({excluded})"
        f" AND lower({schema}) <> 'information_schema')"
    )


S = in_scope()
S2 = in_scope("catalog_name", "schema_name")
BASE = f"{S} AND table_type <> 'VIEW'"

# When a row of a source came to be; nothing later than AS_OF is seen.
BEGUN = {
    "access.audit": "event_date", "access.table_lineage": "event_date",
    "access.column_lineage": "event_date", "access.assistant_events": "event_time",
    "access.outbound_network": "event_time", "billing.usage": "usage_date",
    "compute.clusters": "change_time", "compute.warehouses": "change_time",
    "compute.node_timeline": "start_time", "compute.instance_events": "event_time",
    "compute.warehouse_events": "event_time", "query.history": "start_time",
    "lakeflow.jobs": "change_time", "lakeflow.job_run_timeline": "period_start_time",
    "lakeflow.pipelines": "change_time",
    "lakeflow.pipeline_update_timeline": "update_start_time",
    "mlflow.runs_latest": "start_time", "mlflow.run_metrics_history": "metric_time",
    "serving.endpoint_usage": "request_time", "ai_gateway.usage": "request_time",
    "storage.table_metrics_history": "snapshot_date",
    "storage.predictive_optimization_operations_history": "start_time",
}
ENDED = ("delete_time", "endpoint_delete_time", "table_dropped_time")


def _at_as_of(source: str) -> str:
    """The source as it was at AS_OF: later rows unseen, later deletions undone."""
    sql = flat_sql(source, FIVE)
    columns = FLAT[source][1]
    undone = ", ".join(
        f"CASE WHEN {c} <= {AS_OF_TIME} THEN {c} END AS {c}" for c in ENDED if c in columns
    )
    shown = f"* REPLACE ({undone})" if undone else "*"
    begun = BEGUN.get(source)
    if begun is None:
        return f"SELECT {shown} FROM ({sql})" if undone else sql
    end = AS_OF_DAY if begun.endswith("_date") else AS_OF_TIME
    return f"SELECT {shown} FROM ({sql}) WHERE {begun} IS NULL OR {begun} <= {end}"


# Later views may use earlier ones.
VIEWS: dict[str, str] = {view_name(s): _at_as_of(s) for s in FLAT}
VIEWS["x_own_catalogs"] = (
    "SELECT * FROM x_catalogs WHERE NOT (lower(catalog_name) LIKE 'system' OR"
    " lower(catalog_name) LIKE 'samples')"
)
_PRODUCTION = (
    "(lower(catalog_name) LIKE 'prod%' OR lower(catalog_name) LIKE 'main' OR"
    " lower(catalog_name) LIKE '%_prod' OR lower(catalog_name) LIKE '%_production')"
)
VIEWS["x_scope"] = (
    f"SELECT catalog_name FROM x_own_catalogs WHERE {_PRODUCTION} OR NOT EXISTS"
    f" (SELECT 1 FROM x_own_catalogs WHERE {_PRODUCTION})"
)
VIEWS["x_queries"] = (
    "SELECT *, lower(statement_text) AS text, execution_status = 'FINISHED' AS done"
    f" FROM x_history WHERE start_time >= {WINDOW_TIME}"
)
VIEWS["x_recent_usage"] = (
    "SELECT *, lower(coalesce(sku_name, '')) AS sku,"
    " lower(coalesce(billing_origin_product, '')) AS product,"
    " coalesce(is_serverless, lower(coalesce(sku_name, '')) LIKE '%serverless%') AS on_serverless"
    f" FROM x_usage WHERE usage_date >= {WINDOW_DAY}"
)
VIEWS["x_recent_audit"] = f"SELECT * FROM x_audit WHERE event_date >= {WINDOW_DAY}"
VIEWS["x_recent_lineage"] = f"SELECT * FROM x_table_lineage WHERE event_date >= {WINDOW_DAY}"
VIEWS["x_live_runs"] = (
    f"SELECT * FROM x_runs_latest WHERE delete_time IS NULL AND start_time >= {WINDOW_TIME}"
)
VIEWS["x_recent_job_runs"] = (
    f"SELECT * FROM x_job_run_timeline WHERE period_start_time >= {WINDOW_TIME}"
)
VIEWS["x_live_served"] = "SELECT * FROM x_served_entities WHERE endpoint_delete_time IS NULL"
VIEWS["x_latest_jobs"] = _latest("x_jobs", "job_id", "change_time", "delete_time")
VIEWS["x_latest_pipelines"] = _latest(
    "x_pipelines", "pipeline_id", "change_time", "delete_time"
)
VIEWS["x_latest_warehouses"] = _latest(
    "x_warehouses", "warehouse_id", "change_time", "delete_time"
)
VIEWS["x_latest_clusters"] = _latest(
    "x_clusters", "cluster_id", "change_time", "delete_time", f"change_time >= {WINDOW_TIME}"
)
VIEWS["x_latest_storage"] = _latest(
    "x_table_metrics_history", "table_id", "snapshot_date", "table_dropped_time", S2
)


def with_views(body: str, instead: dict[str, str] | None = None) -> str:
    """``body`` with the views it uses in front; ``instead`` replaces some of them."""
    views = VIEWS | (instead or {})
    needed: set[str] = set()
    frontier = [body]
    while frontier:
        for name in set(re.findall(r"\bx_[a-z_]+\b", frontier.pop())) - needed:
            if name in views:
                needed.add(name)
                frontier.append(views[name])
    ctes = ", ".join(f"{n} AS ({views[n]})" for n in views if n in needed)
    return f"WITH {ctes} {body}" if ctes else body
