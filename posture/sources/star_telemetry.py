"""Telemetry-shaped relations derived from the star-schema test tables.

The test data holds no telemetry, so each source is a projection of one star-schema
table by integer remainders and CASE. The flat projections are plain SQL that Spark
and other engines read alike; ``NESTED`` then wraps flat columns into the structs,
maps and arrays the sources have. All activity ends just before ``AS_OF``.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from posture.sources.registry import Sources

AS_OF = datetime(2024, 1, 31, tzinfo=UTC)

# Days that move the last order and shipping dates next to AS_OF.
ORDER_SHIFT, SHIP_SHIFT = 8217, 8122

_CATALOG = (
    "CASE p_partkey % 8 WHEN 0 THEN 'prod_sales' WHEN 1 THEN 'main'"
    " WHEN 2 THEN 'sales_production' WHEN 3 THEN 'dev_sandbox' WHEN 4 THEN 'nonprod'"
    " WHEN 5 THEN 'hive_metastore' WHEN 6 THEN 'system' ELSE 'nation_10' END"
)
_SCHEMA = (
    "CASE p_type WHEN 'ECONOMY' THEN 'bronze' WHEN 'SMALL' THEN 'silver'"
    " WHEN 'MEDIUM' THEN 'gold_mart' WHEN 'PROMO' THEN 'test_promo'"
    " WHEN 'LARGE' THEN 'information_schema' ELSE 'ops' END"
)
_TABLE = (
    "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) ||"
    " CASE p_size % 10 WHEN 0 THEN '_bak' WHEN 1 THEN '_quarantine' ELSE '' END"
)
_SIZE_TABLE = "'t_' || CAST(p_size AS STRING)"
_ORDERED = f"o_orderdate + INTERVAL '{ORDER_SHIFT}' DAY"
_EVENT_DAY = "CAST(ts AS DATE) - CAST(event_id % 5 AS INT) * 30"

# view: (star table, {column: expression})
FLAT: dict[str, tuple[str, dict[str, str]]] = {
    "information_schema.catalogs": (
        "nation",
        {
            "catalog_name": (
                "CASE n_nationkey WHEN 0 THEN 'system' WHEN 1 THEN 'prod_sales'"
                " WHEN 2 THEN 'main' WHEN 3 THEN 'sales_production'"
                " WHEN 4 THEN 'dev_sandbox' WHEN 5 THEN 'nonprod'"
                " WHEN 6 THEN 'hive_metastore' ELSE lower(n_name) END"
            ),
            "catalog_owner": "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'owner' END",
            "comment": (
                "CASE WHEN n_nationkey % 3 = 0 THEN ' ' WHEN n_nationkey % 3 = 1 THEN n_name"
                " END"
            ),
            "custom_max_retention_hours": "CASE WHEN n_nationkey % 2 = 0 THEN 168 END",
        },
    ),
    "information_schema.tables": (
        "part",
        {
            "table_catalog": _CATALOG,
            "table_schema": _SCHEMA,
            "table_name": _TABLE,
            "table_type": (
                "CASE p_size % 6 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'METRIC_VIEW'"
                " WHEN 2 THEN 'STREAMING_TABLE' ELSE 'MANAGED' END"
            ),
            "table_owner": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END",
            "comment": (
                "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE p_name END"
            ),
            "data_source_format": (
                "CASE p_size % 7 WHEN 0 THEN 'PARQUET' WHEN 1 THEN 'ICEBERG' WHEN 2 THEN NULL"
                " WHEN 3 THEN 'MYSQL' ELSE 'DELTA' END"
            ),
        },
    ),
    # Five columns per table: r_regionkey is 0 to 4.
    "information_schema.columns": (
        "(SELECT *, {five} AS r_regionkey FROM part)",
        {
            "table_catalog": _CATALOG,
            "table_schema": _SCHEMA,
            "table_name": _TABLE,
            "column_name": (
                "CASE WHEN r_regionkey = 4 AND p_size % 9 = 0 THEN '_rescued_data'"
                " WHEN r_regionkey = 3 AND p_size % 11 = 0 THEN 'Rescued_Data'"
                " ELSE 'c' || CAST(r_regionkey AS STRING) END"
            ),
            "comment": "CASE WHEN (p_partkey + r_regionkey) % 3 = 0 THEN 'doc' END",
            "is_nullable": (
                "CASE WHEN (p_partkey + r_regionkey) % 4 = 0 THEN 'NO' ELSE 'YES' END"
            ),
            "partition_index": "CASE WHEN r_regionkey < p_size % 5 THEN r_regionkey END",
        },
    ),
    "information_schema.views": (
        "part",
        {
            "view_definition": (
                "CASE p_size % 10 WHEN 0 THEN 'select * from system.access.table_lineage'"
                " WHEN 1 THEN 'SELECT 1 FROM System.Access.column_lineage' WHEN 2 THEN NULL"
                " ELSE 'select 1' END"
            ),
        },
    ),
    "information_schema.table_tags": (
        "part",
        {
            "catalog_name": _CATALOG,
            "schema_name": _SCHEMA,
            "table_name": _TABLE,
            "tag_name": (
                "CASE p_size % 8 WHEN 0 THEN 'Certified' WHEN 1 THEN 'Feature_Set'"
                " WHEN 2 THEN 'team' WHEN 3 THEN 'pii' ELSE 'domain' END"
            ),
            "tag_value": "CASE p_size % 9 WHEN 0 THEN 'Gold' WHEN 1 THEN NULL ELSE 'x' END",
        },
    ),
    "information_schema.table_constraints": (
        "part",
        {
            "table_catalog": _CATALOG,
            "table_schema": _SCHEMA,
            "table_name": _SIZE_TABLE,
            "constraint_type": (
                "CASE WHEN p_size = 50 THEN NULL WHEN p_size % 3 = 0 THEN 'PRIMARY KEY'"
                " WHEN p_size % 3 = 1 THEN 'FOREIGN KEY' ELSE 'CHECK' END"
            ),
        },
    ),
    "information_schema.table_privileges": (
        "customer",
        {
            "table_catalog": (
                "CASE c_custkey % 4 WHEN 0 THEN 'prod_sales' WHEN 1 THEN 'main'"
                " WHEN 2 THEN 'nonprod' ELSE 'dev_sandbox' END"
            ),
            "table_schema": (
                "CASE c_custkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'test_x' ELSE 'ops' END"
            ),
            "grantee": (
                "CASE c_custkey % 7 WHEN 0 THEN lower(c_name) || '@example.org'"
                " ELSE 'group_' || CAST(c_custkey % 20 AS STRING) END"
            ),
        },
    ),
    "information_schema.schema_privileges": (
        "customer",
        {
            "grantee": "'p_' || CAST(c_custkey % 400 AS STRING)",
            "privilege_type": (
                "CASE c_custkey % 5 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'USE_SCHEMA'"
                " WHEN 2 THEN 'Usage' WHEN 3 THEN NULL ELSE 'MODIFY' END"
            ),
        },
    ),
    "information_schema.routines": (
        "part",
        {
            "routine_catalog": _CATALOG,
            "routine_schema": _SCHEMA,
            "external_language": (
                "CASE p_size % 4 WHEN 0 THEN 'PYTHON' WHEN 1 THEN 'scala' WHEN 2 THEN NULL"
                " ELSE 'SQL' END"
            ),
        },
    ),
    "information_schema.connections": ("nation", {"connection_name": "n_name"}),
    "information_schema.external_locations": (
        "nation",
        {"external_location_name": "n_name"},
    ),
    "information_schema.storage_credentials": (
        "region",
        {"storage_credential_name": "r_name"},
    ),
    "information_schema.shares": ("region", {"share_name": "r_name"}),
    "information_schema.table_share_usage": (
        "nation",
        {"share_name": "'s_' || CAST(n_regionkey AS STRING)"},
    ),
    "information_schema.recipient_allowed_ip_ranges": (
        "nation",
        {"recipient_name": "'r_' || CAST(n_regionkey AS STRING)"},
    ),
    "access.audit": (
        "events",
        {
            "event_date": _EVENT_DAY,
            "action_name": (
                "CASE event_id % 7 WHEN 0 THEN 'createTable' WHEN 1 THEN 'updateTable'"
                " WHEN 2 THEN 'commandSubmit' WHEN 3 THEN 'login' WHEN 4 THEN NULL"
                " ELSE 'getTable' END"
            ),
            "service_name": (
                "CASE event_id % 4 WHEN 0 THEN 'unityCatalog' WHEN 1 THEN 'notebook'"
                " WHEN 2 THEN 'clusters' ELSE 'accounts' END"
            ),
            "user_agent": (
                "CASE event_id % 12 WHEN 0 THEN 'Terraform/1.5' WHEN 1 THEN 'pulumi'"
                " WHEN 2 THEN 'Datadog/' || CAST(user_id % 3 AS STRING) WHEN 3 THEN 'grafana'"
                " WHEN 4 THEN NULL ELSE 'browser' END"
            ),
            "statement": "CASE event_id % 15 WHEN 0 THEN 'ALTER TABLE t ADD COLUMN c' END",
            "error_message": (
                "CASE event_id % 50 WHEN 0 THEN 'Quota used up' WHEN 1 THEN 'Too Many Requests'"
                " WHEN 2 THEN 'denied' END"
            ),
            "status_code": (
                "CASE event_id % 40 WHEN 0 THEN '429' WHEN 1 THEN 'abc' ELSE '200' END"
            ),
        },
    ),
    "access.table_lineage": (
        "events",
        {
            "event_date": _EVENT_DAY,
            "source_table_catalog": (
                "CASE event_id % 25 WHEN 0 THEN 'hive_metastore' ELSE 'system' END"
            ),
            "source_table_schema": (
                "CASE event_id % 10 WHEN 0 THEN 'access' WHEN 1 THEN 'Access' ELSE 'ops' END"
            ),
            "source_table_name": (
                "CASE event_id % 10 WHEN 0 THEN 'table_lineage' WHEN 1 THEN 'Column_Lineage'"
                " ELSE 't' END"
            ),
            "target_table_catalog": (
                "CASE event_id % 31 WHEN 0 THEN 'Hive_Metastore' ELSE 'prod_sales' END"
            ),
            "target_table_schema": "'gov'",
            "target_table_name": (
                "CASE event_id % 3 WHEN 0 THEN NULL ELSE 'l_' || CAST(user_id AS STRING) END"
            ),
            "entity_id": "CAST(user_id AS STRING)",
            "entity_type": (
                "CASE event_id % 5 WHEN 0 THEN 'NOTEBOOK' WHEN 1 THEN 'Job'"
                " WHEN 2 THEN 'DASHBOARD' WHEN 3 THEN NULL ELSE 'DASHBOARD' END"
            ),
        },
    ),
    "access.column_lineage": ("events", {"event_date": _EVENT_DAY}),
    "access.assistant_events": ("events", {"event_time": "ts"}),
    "access.outbound_network": ("events", {"event_time": "ts"}),
    "access.workspaces_latest": (
        "supplier",
        {"workspace_id": "CAST(s_nationkey AS STRING)"},
    ),
    "billing.usage": (
        "lineitem",
        {
            "usage_date": f"CAST(l_shipdate AS DATE) + {SHIP_SHIFT}",
            "usage_quantity": "l_quantity",
            "sku_name": (
                "CASE l_returnflag WHEN 'A' THEN 'ALL_PURPOSE_COMPUTE'"
                " WHEN 'N' THEN 'JOBS_SERVERLESS' ELSE 'SERVERLESS_SQL_PHOTON' END"
            ),
            "is_serverless": (
                "CASE l_linestatus WHEN 'O' THEN CAST(NULL AS BOOLEAN)"
                " ELSE l_linenumber % 2 = 0 END"
            ),
            "is_photon": "l_linenumber % 3 = 0",
            "billing_origin_product": (
                "CASE l_linenumber % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN NULL ELSE 'JOBS' END"
            ),
            "job_id": (
                "CASE WHEN l_linenumber > 2 THEN CAST(l_orderkey % 300 AS STRING) END"
            ),
            "tag_key": (
                "CASE l_linenumber WHEN 1 THEN 'Team' WHEN 2 THEN 'color'"
                " WHEN 3 THEN 'cost_center' END"
            ),
        },
    ),
    "billing.list_prices": ("supplier", {"sku_name": "s_name"}),
    "compute.clusters": (
        "orders",
        {
            "cluster_id": "CAST(o_custkey % 400 AS STRING)",
            "change_time": _ORDERED,
            "version": "o_orderkey",
            "delete_time": f"CASE WHEN o_orderkey % 10 = 0 THEN {_ORDERED} END",
            "policy_id": "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'p1' END",
            "dbr_version": (
                "CASE o_orderkey % 4 WHEN 0 THEN '12.2.x' WHEN 1 THEN 'custom:x'"
                " WHEN 2 THEN '14.3.x' ELSE '15.4.x' END"
            ),
            "worker_count": "CAST(o_orderkey % 6 AS INT)",
            "min_autoscale_workers": "CASE WHEN o_orderkey % 2 = 0 THEN 1 END",
            "max_autoscale_workers": (
                "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 8 AS INT) END"
            ),
            "worker_node_type": (
                "CASE o_orderkey % 5 WHEN 0 THEN 'Standard_D4_v5' WHEN 1 THEN 'i3.xlarge'"
                " WHEN 2 THEN NULL WHEN 3 THEN 'c5.' || CAST(o_orderkey % 13 AS STRING)"
                " ELSE 'm6g.large' END"
            ),
            "auto_termination_minutes": (
                "CASE o_orderkey % 3 WHEN 0 THEN 0 ELSE CAST(60 + o_orderkey % 100 AS INT) END"
            ),
            "cluster_source": "CASE o_orderkey % 4 WHEN 0 THEN 'JOB' ELSE 'UI' END",
            "first_on_demand": (
                "CASE o_orderkey % 9 WHEN 0 THEN '1' WHEN 1 THEN '999' WHEN 2 THEN 'x' END"
            ),
            "azure_kind": (
                "CASE o_orderkey % 13 WHEN 0 THEN 'SPOT_AZURE' WHEN 1 THEN 'ON_DEMAND' END"
            ),
            "gcp_kind": "CASE o_orderkey % 17 WHEN 0 THEN 'PREEMPTIBLE_GCP' END",
        },
    ),
    "compute.warehouses": (
        "orders",
        {
            "warehouse_id": "CAST(o_custkey % 50 AS STRING)",
            "change_time": _ORDERED,
            "version": "o_orderkey",
            "delete_time": f"CASE WHEN o_orderkey % 9 = 0 THEN {_ORDERED} END",
            "min_clusters": "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE 1 END",
            "max_clusters": "CAST(o_orderkey % 4 AS INT)",
            "auto_stop_minutes": (
                "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 30 END"
            ),
        },
    ),
    "compute.node_timeline": (
        "events",
        {
            "cluster_id": "CAST(user_id AS STRING)",
            "start_time": "ts",
            "cpu_user_percent": "CAST(event_id % 60 AS DOUBLE)",
            "cpu_system_percent": "CAST(event_id % 10 AS DOUBLE)",
            "cpu_wait_percent": (
                "CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS DOUBLE)"
                " ELSE CAST(event_id % 30 AS DOUBLE) END"
            ),
            "mem_used_percent": "CAST(event_id % 95 AS DOUBLE)",
            "mem_swap_percent": "CAST(event_id % 3 AS DOUBLE)",
        },
    ),
    "compute.instance_events": ("events", {"event_time": "ts"}),
    "compute.warehouse_events": (
        "events",
        {
            "event_time": "ts",
            "event_type": (
                "CASE event_type WHEN 'error' THEN 'SCALED_UP_FAILED' WHEN 'view' THEN NULL"
                " ELSE 'RUNNING' END"
            ),
        },
    ),
    "query.history": (
        "events",
        {
            "statement_id": "event_id",
            "start_time": "ts",
            "executed_by": "CAST(user_id AS STRING)",
            "statement_text": (
                "CASE event_id % 20 WHEN 0 THEN 'SELECT * FROM system.access.audit'"
                " WHEN 1 THEN 'select a from t join u on 1=1' WHEN 2 THEN 'OPTIMIZE t'"
                " WHEN 3 THEN 'ANALYZE TABLE t'"
                " WHEN 4 THEN 'select trend from system.billing.usage group by 1'"
                " WHEN 5 THEN 'create or replace function f'"
                " WHEN 6 THEN 'select * from t VERSION AS OF 3'"
                " WHEN 7 THEN 'select ai_query (x)' WHEN 8 THEN 'select * from read_files(p)'"
                " WHEN 9 THEN 'select * from system.query.history'"
                " WHEN 10 THEN 'select 1 from system.access.table_lineage'"
                " WHEN 11 THEN 'select * from STREAM(t)'"
                " WHEN 12 THEN 'alter table t CLUSTER BY (a)'"
                " WHEN 13 THEN 'select ''jdbc:mysql://h'''"
                " WHEN 14 THEN 'select * from system.information_schema.tables'"
                " WHEN 15 THEN NULL ELSE 'select 1' END"
            ),
            "execution_status": (
                "CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'FINISHED' END"
            ),
            "statement_type": "CASE WHEN event_id % 3 = 0 THEN 'INSERT' ELSE 'SELECT' END",
            "client_application": (
                "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Tableau' WHEN 2 THEN 'dbt'"
                " WHEN 3 THEN CASE event_id % 26 WHEN 9 THEN 'Looker'"
                " ELSE 'app_' || CAST(event_id % 26 AS STRING) END ELSE 'jdbc' END"
            ),
            "compute_type": (
                "CASE event_id % 4 WHEN 0 THEN 'WAREHOUSE' WHEN 1 THEN 'warehouse_x'"
                " WHEN 2 THEN NULL ELSE 'CLUSTER' END"
            ),
            "dashboard_id": (
                "CASE WHEN event_id % 4 = 0 THEN 'd' || CAST(user_id % 7 AS STRING) END"
            ),
            "legacy_dashboard_id": (
                "CASE WHEN event_id % 10 = 9 THEN 'o' || CAST(user_id % 5 AS STRING) END"
            ),
            "alert_id": (
                "CASE WHEN event_id % 10 = 4 THEN 'a' || CAST(user_id % 11 AS STRING) END"
            ),
            "genie_space_id": "CASE WHEN event_id % 33 = 0 THEN 'g' END",
            "pruned_files": "event_id % 100",
            "read_files": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 40 END",
            "read_bytes": "CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id * 1000 END",
            "read_partitions": "event_id % 5",
            "read_io_cache_percent": "event_id % 101",
            "from_result_cache": "event_id % 9 = 0",
            "spilled_local_bytes": "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END",
            "shuffle_read_bytes": "event_id % 17 * 100000",
            "total_duration_ms": "event_id % 1000 + 500",
            "execution_duration_ms": "event_id % 1000",
            "compilation_duration_ms": "event_id % 90",
            "result_fetch_duration_ms": "event_id % 30",
            "waiting_for_compute_duration_ms": (
                "CASE WHEN event_id % 10 = 3 THEN 20000 ELSE 0 END"
            ),
            "waiting_at_capacity_duration_ms": "event_id % 19",
        },
    ),
    "lakeflow.jobs": (
        "orders",
        {
            "job_id": "CAST(o_custkey AS STRING)",
            "change_time": _ORDERED,
            "version": "o_orderkey",
            "delete_time": (
                "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0"
                f" THEN {_ORDERED} END"
            ),
            "timeout_seconds": (
                "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 3600 END"
            ),
            "deployment_kind": (
                "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'BUNDLE' END"
            ),
            "health_rules_json": (
                "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE '[x]' END"
            ),
            "name": (
                "CASE o_orderkey % 6 WHEN 0 THEN 'Train_model' WHEN 1 THEN 'eval_nightly'"
                " WHEN 2 THEN NULL ELSE 'etl' END"
            ),
            "trigger_kind": (
                "CASE o_orderkey % 7 WHEN 0 THEN 'schedule' WHEN 1 THEN 'file_arrival'"
                " WHEN 2 THEN 'periodic' WHEN 3 THEN 'table_update' WHEN 4 THEN 'continuous'"
                " WHEN 5 THEN 'none' END"
            ),
            "continuous_enabled": "o_orderkey % 2 = 0",
            "paused": (
                "CASE o_orderkey % 8 WHEN 0 THEN CAST(NULL AS BOOLEAN)"
                " ELSE o_orderkey % 8 = 1 END"
            ),
        },
    ),
    "lakeflow.job_tasks": (
        "lineitem",
        {
            "job_id": "CAST(l_orderkey % 1500 AS STRING)",
            "delete_time": "CASE WHEN l_linenumber = 7 THEN l_shipdate END",
            "dependencies": (
                "CASE WHEN l_linenumber = 2 OR l_orderkey % 4 = 0 THEN NULL"
                " WHEN l_orderkey % 4 = 1 THEN 0 ELSE l_linenumber - 1 END"
            ),
        },
    ),
    "lakeflow.job_run_timeline": (
        "events",
        {
            "job_id": "CAST(user_id AS STRING)",
            "period_start_time": "ts",
            "result_state": (
                "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN NULL"
                " WHEN 'view' THEN 'TIMEDOUT' ELSE 'SUCCEEDED' END"
            ),
            "run_type": (
                "CASE event_id % 20 WHEN 0 THEN 'RETRY_RUN' WHEN 1 THEN 'Repair'"
                " WHEN 2 THEN NULL ELSE 'JOB_RUN' END"
            ),
            "run_duration_seconds": (
                "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 600 END"
            ),
            "queue_duration_seconds": "event_id % 30",
        },
    ),
    "lakeflow.pipelines": (
        "orders",
        {
            "pipeline_id": "CAST(o_custkey % 120 AS STRING)",
            "change_time": _ORDERED,
            "version": "o_orderkey",
            "delete_time": f"CASE WHEN o_orderkey % 11 = 0 THEN {_ORDERED} END",
            "pipeline_type": (
                "CASE o_orderkey % 4 WHEN 0 THEN 'MANAGED_INGESTION' WHEN 1 THEN NULL"
                " ELSE 'ETL' END"
            ),
            "serverless": "o_orderkey % 2 = 0",
            "continuous": "o_orderkey % 5 = 0",
            "development": "o_orderkey % 7 = 0",
        },
    ),
    "lakeflow.pipeline_update_timeline": ("events", {"update_start_time": "ts"}),
    "lakeflow.zerobus_stream": ("region", {"stream_id": "r_name"}),
    "mlflow.experiments_latest": (
        "supplier",
        {
            "experiment_id": "CAST(s_suppkey AS STRING)",
            "delete_time": (
                "CASE WHEN s_suppkey % 6 = 0 THEN CAST('2024-01-01' AS DATE) END"
            ),
        },
    ),
    "mlflow.runs_latest": (
        "events",
        {
            "run_id": "CAST(event_id AS STRING)",
            "start_time": "ts",
            "delete_time": "CASE WHEN event_id % 9 = 0 THEN ts END",
            "run_name": (
                "CASE event_id % 8 WHEN 0 THEN 'nightly_EVAL' WHEN 1 THEN NULL"
                " WHEN 2 THEN 'benchmark-3' ELSE 'train' END"
            ),
            "tag_value": (
                "CASE event_id % 16 WHEN 3 THEN 'mlflow.evaluate' WHEN 4 THEN 'Judge model'"
                " WHEN 5 THEN NULL ELSE 'x' END"
            ),
            "n_params": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 3 END",
            "n_metrics": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 4 END",
        },
    ),
    "mlflow.run_metrics_history": (
        "events",
        {
            "metric_time": "ts",
            "metric_name": (
                "CASE event_id % 10 WHEN 0 THEN 'Toxicity/v1' WHEN 1 THEN 'ROUGE1'"
                " WHEN 2 THEN 'bleu' WHEN 3 THEN 'answer_length' WHEN 4 THEN NULL"
                " ELSE 'loss' END"
            ),
        },
    ),
    "serving.served_entities": (
        "supplier",
        {
            "endpoint_id": "CAST(s_nationkey AS STRING)",
            "served_entity_id": "CAST(s_suppkey AS STRING)",
            "entity_name": "'model_' || CAST(s_suppkey % 20 AS STRING)",
            "entity_type": (
                "CASE s_suppkey % 3 WHEN 0 THEN 'CUSTOM_MODEL' WHEN 1 THEN 'FOUNDATION_MODEL'"
                " ELSE 'EXTERNAL_MODEL' END"
            ),
            "endpoint_delete_time": (
                "CASE WHEN s_suppkey % 5 = 0 THEN CAST('2024-01-01' AS DATE) END"
            ),
            "provider": (
                "CASE s_suppkey % 12 WHEN 2 THEN 'openai' WHEN 5 THEN 'cohere'"
                " WHEN 8 THEN 'openai' END"
            ),
            "max_throughput": "CASE WHEN s_suppkey % 6 = 1 THEN 100 END",
        },
    ),
    "serving.endpoint_usage": ("events", {"request_time": "ts"}),
    "ai_gateway.usage": ("events", {"request_time": "ts"}),
    "storage.table_metrics_history": (
        "orders",
        {
            "table_id": "CAST(o_custkey AS STRING)",
            "catalog_name": (
                "CASE o_custkey % 4 WHEN 0 THEN 'prod_sales' WHEN 1 THEN 'main'"
                " WHEN 2 THEN 'nonprod' ELSE 'dev_sandbox' END"
            ),
            "schema_name": (
                "CASE o_custkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'test_x' ELSE 'ops' END"
            ),
            "snapshot_date": f"CAST(o_orderdate AS DATE) + {ORDER_SHIFT}",
            "version": "o_orderkey",
            "table_dropped_time": f"CASE WHEN o_orderkey % 12 = 0 THEN {_ORDERED} END",
            "predictive_optimization_enabled": (
                "CASE o_orderkey % 4 WHEN 0 THEN 'INHERIT' WHEN 1 THEN 'ENABLE'"
                " WHEN 2 THEN 'DISABLE' END"
            ),
            "active_bytes": "o_orderkey * 20000",
            "active_files": "o_orderkey % 20",
            "cloned": "o_orderkey % 20 = 0",
        },
    ),
    "storage.predictive_optimization_operations_history": (
        "events",
        {
            "table_id": "CAST(user_id AS STRING)",
            "operation_type": (
                "CASE event_id % 6 WHEN 0 THEN 'COMPACTION' WHEN 1 THEN 'ANALYZE'"
                " WHEN 2 THEN 'VACUUM' WHEN 3 THEN 'Compute_Stats' WHEN 4 THEN NULL"
                " ELSE 'CLUSTERING' END"
            ),
            "start_time": "ts",
        },
    ),
    "data_quality_monitoring.table_results": (
        "part",
        {
            "catalog_name": _CATALOG,
            "schema_name": _SCHEMA,
            "table_name": _SIZE_TABLE,
        },
    ),
    "replication.states": ("region", {"state": "r_name"}),
    "sharing.materialization_history": ("nation", {"share_name": "n_name"}),
    # git_credentials is left out: a collection that was not taken.
    "workspace_inventory": (
        "supplier",
        {
            "collection": (
                "CASE s_suppkey % 4 WHEN 0 THEN 'registered_models' WHEN 1 THEN 'recipients'"
                " WHEN 2 THEN 'cluster_policies' ELSE 'repos' END"
            ),
            "item_id": "CAST(s_suppkey AS STRING)",
        },
    ),
}

# source: ({nested column: Spark expression}, flat columns it replaces)
NESTED: dict[str, tuple[dict[str, str], tuple[str, ...]]] = {
    "access.audit": (
        {
            "request_params": "named_struct('statement', statement)",
            "response": (
                "named_struct('error_message', error_message, 'status_code', status_code)"
            ),
        },
        ("statement", "error_message", "status_code"),
    ),
    "billing.usage": (
        {
            "product_features": (
                "named_struct('is_serverless', is_serverless, 'is_photon', is_photon)"
            ),
            "usage_metadata": "named_struct('job_id', job_id)",
            "custom_tags": "CASE WHEN tag_key IS NOT NULL THEN map(tag_key, 'v') END",
        },
        ("is_serverless", "is_photon", "job_id", "tag_key"),
    ),
    "compute.clusters": (
        {
            "aws_attributes": "named_struct('first_on_demand', first_on_demand)",
            "azure_attributes": (
                "CASE WHEN azure_kind IS NOT NULL"
                " THEN named_struct('availability', azure_kind) END"
            ),
            "gcp_attributes": (
                "CASE WHEN gcp_kind IS NOT NULL THEN named_struct('availability', gcp_kind) END"
            ),
        },
        ("first_on_demand", "azure_kind", "gcp_kind"),
    ),
    "query.history": (
        {
            "compute": "named_struct('type', compute_type)",
            "query_source": (
                "named_struct('dashboard_id', dashboard_id, 'legacy_dashboard_id',"
                " legacy_dashboard_id, 'alert_id', alert_id, 'genie_space_id', genie_space_id)"
            ),
        },
        ("compute_type", "dashboard_id", "legacy_dashboard_id", "alert_id", "genie_space_id"),
    ),
    "lakeflow.jobs": (
        {
            "deployment": (
                "CASE WHEN deployment_kind IS NOT NULL"
                " THEN named_struct('kind', deployment_kind) END"
            ),
            "health_rules": (
                "CASE health_rules_json WHEN '[]' THEN"
                " CAST(array() AS ARRAY<STRUCT<metric: STRING>>)"
                " WHEN '[x]' THEN array(named_struct('metric', 'duration')) END"
            ),
            "trigger": (
                "CASE WHEN trigger_kind IS NOT NULL THEN named_struct("
                "'schedule', CASE WHEN trigger_kind = 'schedule' THEN 'x' END,"
                " 'file_arrival', CASE WHEN trigger_kind = 'file_arrival' THEN 'x' END,"
                " 'periodic', CASE WHEN trigger_kind = 'periodic' THEN 'x' END,"
                " 'table_update', CASE WHEN trigger_kind = 'table_update' THEN 'x' END,"
                " 'continuous', CASE WHEN trigger_kind = 'continuous'"
                " THEN named_struct('enabled', continuous_enabled) END) END"
            ),
        },
        ("deployment_kind", "health_rules_json", "trigger_kind", "continuous_enabled"),
    ),
    "lakeflow.job_tasks": (
        {"depends_on_keys": "array_repeat('t', dependencies)"},
        ("dependencies",),
    ),
    "lakeflow.pipelines": (
        {
            "settings": (
                "named_struct('serverless', serverless, 'continuous', continuous,"
                " 'development', development)"
            ),
        },
        ("serverless", "continuous", "development"),
    ),
    "mlflow.runs_latest": (
        {
            "tags": "CASE WHEN tag_value IS NOT NULL THEN map('k', tag_value) END",
            "params": (
                "CASE WHEN n_params = 0 THEN CAST(map() AS MAP<STRING, STRING>)"
                " WHEN n_params > 0 THEN map('p', '1') END"
            ),
            "aggregated_metrics": (
                "CASE WHEN n_metrics IS NOT NULL"
                " THEN array_repeat(named_struct('name', 'm'), CAST(n_metrics AS INT)) END"
            ),
        },
        ("tag_value", "n_params", "n_metrics"),
    ),
    "serving.served_entities": (
        {
            "external_model_config": (
                "CASE WHEN entity_type = 'EXTERNAL_MODEL'"
                " THEN named_struct('provider', provider) END"
            ),
            "foundation_model_config": (
                "CASE WHEN entity_type = 'FOUNDATION_MODEL'"
                " THEN named_struct('max_provisioned_throughput', max_throughput) END"
            ),
            "custom_model_config": (
                "CASE WHEN entity_type = 'CUSTOM_MODEL' THEN named_struct('size', 'S') END"
            ),
        },
        ("provider", "max_throughput"),
    ),
    "storage.table_metrics_history": (
        {"clone_details": "CASE WHEN cloned THEN named_struct('kind', 'DEEP') END"},
        ("cloned",),
    ),
}

FIVE_IN_SPARK = "explode(array(0, 1, 2, 3, 4))"


def flat_sql(source: str, five: str) -> str:
    """The flat projection; ``five`` is the dialect's way to repeat a row five times."""
    base, columns = FLAT[source]
    listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {listed} FROM {base.format(five=five)}"


def star_table(source: str) -> str:
    """The star table a source is derived from."""
    base = FLAT[source][0]
    return "part" if base.startswith("(") else base


def derive(star: DataFrame, source: str) -> DataFrame:
    """One telemetry source from its star table."""
    base, columns = FLAT[source]
    if base.startswith("("):
        star = star.selectExpr("*", f"{FIVE_IN_SPARK} AS r_regionkey")
    nested, replaced = NESTED.get(source, ({}, ()))
    kept = [c for c in columns if c not in replaced]
    flat = star.selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))
    if not nested:
        return flat
    return flat.selectExpr(*kept, *(f"{e} AS {n}" for n, e in nested.items()))


def star_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """All sources over the Parquet files of ``sf_dir``, each file opened once."""

    @cache
    def star(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    def loader(source: str):
        return lambda _: derive(star(star_table(source)), source)

    return Sources(spark, {source: loader(source) for source in FLAT}, probe_rows=False)
