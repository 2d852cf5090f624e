"""Columns the measurements read, per source (DDL)."""

SCHEMAS = {
    "information_schema.catalogs": (
        "catalog_name string, catalog_owner string, comment string,"
        " custom_max_retention_hours bigint"
    ),
    "information_schema.tables": (
        "table_catalog string, table_schema string, table_name string, table_type string,"
        " table_owner string, comment string, data_source_format string"
    ),
    "information_schema.columns": (
        "table_catalog string, table_schema string, table_name string, column_name string,"
        " comment string, is_nullable string, partition_index int"
    ),
    "information_schema.views": "view_definition string",
    "information_schema.table_tags": (
        "catalog_name string, schema_name string, table_name string, tag_name string,"
        " tag_value string"
    ),
    "information_schema.table_constraints": (
        "table_catalog string, table_schema string, table_name string, constraint_type string"
    ),
    "information_schema.table_privileges": (
        "table_catalog string, table_schema string, grantee string"
    ),
    "information_schema.schema_privileges": "grantee string, privilege_type string",
    "information_schema.routines": (
        "routine_catalog string, routine_schema string, external_language string"
    ),
    "information_schema.connections": "connection_name string",
    "information_schema.external_locations": "external_location_name string",
    "information_schema.storage_credentials": "storage_credential_name string",
    "information_schema.shares": "share_name string",
    "information_schema.table_share_usage": "share_name string",
    "information_schema.recipient_allowed_ip_ranges": "recipient_name string",
    "access.audit": (
        "event_date date, action_name string, service_name string, user_agent string,"
        " request_params struct<statement:string>,"
        " response struct<error_message:string,status_code:string>"
    ),
    "access.table_lineage": (
        "event_date date, source_table_catalog string, source_table_schema string,"
        " source_table_name string, target_table_catalog string, target_table_schema string,"
        " target_table_name string, entity_id string, entity_type string"
    ),
    "access.column_lineage": "event_date date",
    "access.assistant_events": "event_time timestamp",
    "access.outbound_network": "event_time timestamp",
    "access.workspaces_latest": "workspace_id string",
    "billing.usage": (
        "usage_date date, usage_quantity double, sku_name string,"
        " billing_origin_product string,"
        " product_features struct<is_serverless:boolean,is_photon:boolean>,"
        " usage_metadata struct<job_id:string>, custom_tags map<string,string>"
    ),
    "billing.list_prices": "sku_name string",
    "compute.clusters": (
        "cluster_id string, change_time timestamp, delete_time timestamp, policy_id string,"
        " dbr_version string, worker_node_type string, driver_node_type string,"
        " cluster_source string, worker_count int, min_autoscale_workers int,"
        " max_autoscale_workers int, auto_termination_minutes int,"
        " aws_attributes struct<first_on_demand:string>,"
        " azure_attributes struct<availability:string>,"
        " gcp_attributes struct<availability:string>"
    ),
    "compute.warehouses": (
        "warehouse_id string, change_time timestamp, delete_time timestamp,"
        " min_clusters int, max_clusters int, auto_stop_minutes int"
    ),
    "compute.node_timeline": (
        "cluster_id string, start_time timestamp, cpu_user_percent double,"
        " cpu_system_percent double, cpu_wait_percent double, mem_used_percent double,"
        " mem_swap_percent double"
    ),
    "compute.instance_events": "event_time timestamp",
    "compute.warehouse_events": "event_time timestamp, event_type string",
    "query.history": (
        "start_time timestamp, executed_by string, statement_text string,"
        " statement_type string, execution_status string, client_application string,"
        " compute struct<type:string>,"
        " query_source struct<dashboard_id:string,legacy_dashboard_id:string,"
        "alert_id:string,genie_space_id:string>,"
        " read_bytes bigint, read_files bigint, pruned_files bigint, read_partitions bigint,"
        " spilled_local_bytes bigint, shuffle_read_bytes bigint,"
        " read_io_cache_percent bigint, from_result_cache boolean,"
        " total_duration_ms bigint, execution_duration_ms bigint,"
        " compilation_duration_ms bigint, result_fetch_duration_ms bigint,"
        " waiting_for_compute_duration_ms bigint, waiting_at_capacity_duration_ms bigint"
    ),
    "lakeflow.jobs": (
        "job_id string, name string, change_time timestamp, delete_time timestamp,"
        " deployment struct<kind:string>,"
        " trigger struct<schedule:string,file_arrival:string,periodic:string,"
        "table_update:string,continuous:struct<enabled:boolean>>,"
        " paused boolean, timeout_seconds int, health_rules array<struct<metric:string>>"
    ),
    "lakeflow.job_tasks": "job_id string, delete_time timestamp, depends_on_keys array<string>",
    "lakeflow.job_run_timeline": (
        "job_id string, period_start_time timestamp, result_state string, run_type string,"
        " run_duration_seconds bigint, queue_duration_seconds bigint"
    ),
    "lakeflow.pipelines": (
        "pipeline_id string, pipeline_type string, change_time timestamp,"
        " delete_time timestamp,"
        " settings struct<serverless:boolean,continuous:boolean,development:boolean>"
    ),
    "lakeflow.pipeline_update_timeline": "update_start_time timestamp",
    "lakeflow.zerobus_stream": "stream_id string",
    "mlflow.experiments_latest": "experiment_id string, delete_time timestamp",
    "mlflow.runs_latest": (
        "run_id string, start_time timestamp, delete_time timestamp, run_name string,"
        " tags map<string,string>, params map<string,string>,"
        " aggregated_metrics array<struct<name:string>>"
    ),
    "mlflow.run_metrics_history": "metric_time timestamp, metric_name string",
    "serving.served_entities": (
        "endpoint_id string, served_entity_id string, entity_name string, entity_type string,"
        " endpoint_delete_time timestamp, external_model_config struct<provider:string>,"
        " foundation_model_config struct<max_provisioned_throughput:bigint>,"
        " custom_model_config struct<size:string>"
    ),
    "serving.endpoint_usage": "request_time timestamp",
    "ai_gateway.usage": "request_time timestamp",
    "storage.table_metrics_history": (
        "table_id string, catalog_name string, schema_name string, snapshot_date date,"
        " table_dropped_time timestamp, predictive_optimization_enabled string,"
        " active_bytes bigint, active_files bigint, clone_details struct<kind:string>"
    ),
    "storage.predictive_optimization_operations_history": (
        "table_id string, operation_type string, start_time timestamp"
    ),
    "data_quality_monitoring.table_results": (
        "catalog_name string, schema_name string, table_name string"
    ),
    "replication.states": "state string",
    "sharing.materialization_history": "share_name string",
    "workspace_inventory": "collection string, item_id string",
}
