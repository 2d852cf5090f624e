"""One SQL statement per question: status and metrics, written apart from the engine."""

from __future__ import annotations

from oracle.views import (
    BASE,
    DAY_30,
    DAY_60,
    S,
    S2,
    TIME_7,
    TIME_30,
    WINDOW_DAY,
    WINDOW_TIME,
    in_scope,
    with_views,
)

BODIES: dict[str, str] = {}


def _ratio(at: float = 0.8) -> str:
    return (
        "CASE WHEN coalesce(denominator, 0) = 0 OR numerator IS NULL THEN 'open'"
        f" WHEN CAST(numerator AS DOUBLE) / denominator >= {at} THEN 'completed'"
        " ELSE 'in-progress' END"
    )


RATIO = _ratio()


def add(question_id: str, status: str, measured: str) -> None:
    BODIES[question_id] = (
        f"SELECT '{question_id}' AS question_id, {status} AS status, m.* FROM ({measured}) AS m"
    )


def one(select: str, source: str) -> str:
    return f"(SELECT {select} FROM {source})"


def fields(**parts: str) -> str:
    """A one-row SELECT; each part is a scalar expression or subquery."""
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in parts.items())


def over(source: str, where: str = "TRUE", **parts: str) -> str:
    return fields(**parts) + f" FROM {source} WHERE {where}"


def n(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def filled(column: str) -> str:
    return f"({column} IS NOT NULL AND trim({column}) <> '')"


def signals(*names: str) -> str:
    total = " + ".join(f"CAST({c} > 0 AS INT)" for c in names)
    return (
        f"CASE WHEN {total} = 0 THEN 'open' WHEN {total} = 1 THEN 'in-progress'"
        " ELSE 'completed' END"
    )


TABLES = one("count(*)", f"x_tables WHERE {BASE}")
LEGACY = one(
    "count(*)",
    "x_tables WHERE lower(table_catalog) = 'hive_metastore' AND table_type <> 'VIEW'",
)
PIPELINES = one("count(*)", "x_pipelines WHERE delete_time IS NULL")
JOBS = one("count(DISTINCT job_id)", "x_jobs WHERE delete_time IS NULL")
INGESTION = one(
    "count(*)",
    "x_pipelines WHERE delete_time IS NULL AND"
    " regexp_matches(lower(coalesce(pipeline_type, '')), '(ingestion|managed)')",
)
FILES = one(
    "count(*)", "x_queries WHERE text LIKE '%cloudfiles%' OR text LIKE '%read_files(%'"
)
RUNS = one("count(*)", "x_live_runs")
EXPERIMENTS = one("count(*)", "x_experiments_latest WHERE delete_time IS NULL")
ROUTINES = one("count(*)", f"x_routines WHERE {in_scope('routine_catalog', 'routine_schema')}")
TRIPLE = "concat_ws('.', table_catalog, table_schema, table_name)"
TRIPLE2 = "concat_ws('.', catalog_name, schema_name, table_name)"
CONSTRAINED = one(f"count(DISTINCT {TRIPLE})", f"x_table_constraints WHERE {S}")
WORKSPACES = one("count(DISTINCT workspace_id)", "x_workspaces_latest")
HEALTH_RULES = one("count(*)", "x_latest_jobs WHERE health_rules_json NOT IN ('[]')")
DEPENDENT = one(
    "count(DISTINCT job_id)", "x_job_tasks WHERE delete_time IS NULL AND dependencies > 0"
)
SERVERLESS_JOBS = one("count(DISTINCT job_id)", "x_recent_usage WHERE on_serverless")
ON_SYSTEM = "text LIKE '%system.%'"
ON_BILLING = "text LIKE '%system.billing%'"
DASHBOARD = "coalesce(dashboard_id, legacy_dashboard_id)"


def rows(view: str, where: str = "TRUE") -> str:
    return one("count(*)", f"{view} WHERE {where}")


def inventory(collection: str) -> str:
    return one("nullif(count(*), 0)", f"x_workspace_inventory WHERE collection = '{collection}'")


PERSONAL = n("grantee ILIKE '%@%'")

# --- governance -----------------------------------------------------------------------
add(
    "DG-01-02",
    RATIO,
    over(
        "x_tables",
        BASE,
        numerator=n(filled("comment")),
        denominator="count(*)",
        owned=n(filled("table_owner")),
    ),
)
add(
    "DG-01-03",
    RATIO,
    "SELECT *, uc_tables AS numerator, uc_tables + hive_metastore_tables AS denominator FROM ("
    + fields(
        hive_metastore_tables=LEGACY,
        uc_tables=TABLES,
        lineage_queries=rows("x_queries", "text LIKE '%system.access.%lineage%'"),
        lineage_query_principals=one(
            "count(DISTINCT executed_by)", "x_queries WHERE text LIKE '%system.access.%lineage%'"
        ),
        lineage_derived_views=rows(
            "x_views", "lower(view_definition) LIKE '%system.access.%lineage%'"
        ),
        lineage_derived_tables=one(
            "count(DISTINCT concat_ws('.', target_table_catalog, target_table_schema,"
            " target_table_name))",
            "x_recent_lineage WHERE lower(source_table_schema) = 'access' AND"
            " regexp_matches(lower(source_table_name), 'lineage') AND"
            " target_table_name IS NOT NULL",
        ),
    )
    + ")",
)
add(
    "DG-01-04",
    RATIO,
    over("x_columns", S, numerator=n(filled("comment")), denominator="count(*)"),
)
add(
    "DG-01-05",
    RATIO,
    "SELECT CASE WHEN denominator = 0 THEN tagged ELSE least(tagged, denominator) END"
    " AS numerator, denominator, distinct_tag_names, tagged AS tagged_tables FROM ("
    + fields(
        denominator=TABLES,
        tagged=one(f"count(DISTINCT {TRIPLE2})", f"x_table_tags WHERE {S2}"),
        distinct_tag_names=one("count(DISTINCT tag_name)", f"x_table_tags WHERE {S2}"),
    )
    + ")",
)
add(
    "DG-01-06",
    "CASE WHEN uc_models > 0 THEN 'completed' WHEN uc_functions > 0 THEN 'in-progress'"
    " ELSE 'open' END",
    fields(
        uc_models=f"coalesce({inventory('registered_models')}, 0)",
        uc_functions=ROUTINES,
        experiments=EXPERIMENTS,
    ),
)
add(
    "DG-02-01",
    f"CASE WHEN ({RATIO}) = 'completed' AND hive_lineage_events > 0 THEN 'in-progress'"
    f" ELSE ({RATIO}) END",
    over(
        "x_table_privileges",
        S,
        numerator=f"count(*) - {PERSONAL}",
        denominator="count(*)",
        user_grants=PERSONAL,
        hive_lineage_events=rows(
            "x_recent_lineage",
            "lower(source_table_catalog) = 'hive_metastore' OR"
            " lower(target_table_catalog) = 'hive_metastore'",
        ),
    ),
)
add(
    "DG-02-02",
    RATIO,
    over(
        "x_recent_audit",
        numerator="CASE WHEN count(*) > 0 THEN count(DISTINCT event_date) END",
        denominator="CAST(90 AS BIGINT)",
        events="count(*)",
    ),
)
add(
    "DG-02-03",
    "CASE WHEN audit_queries = 0 THEN 'in-progress' ELSE 'completed' END",
    fields(
        unique_actions=one("count(DISTINCT action_name)", "x_recent_audit"),
        audit_queries=rows("x_queries", "text LIKE '%system.access.audit%'"),
        audit_consumers=one(
            "count(DISTINCT executed_by)", "x_queries WHERE text LIKE '%system.access.audit%'"
        ),
    ),
)
add(
    "DG-03-02",
    f"CASE WHEN monitored + constrained + declarative_pipelines = 0 THEN 'open' ELSE ({RATIO}) END",
    "SELECT *, CASE WHEN denominator = 0 THEN 0 ELSE least(monitored + constrained, denominator)"
    " END AS numerator FROM ("
    + fields(
        denominator=TABLES,
        monitored=one(f"count(DISTINCT {TRIPLE2})", f"x_table_results WHERE {S2}"),
        constrained=CONSTRAINED,
        declarative_pipelines=PIPELINES,
    )
    + ")",
)
TRANSACTIONAL = over(
    "x_tables",
    BASE,
    numerator=n("lower(coalesce(data_source_format, '')) IN ('delta', 'deltasharing')"),
    denominator="count(*)",
)
add("DG-03-03", RATIO, TRANSACTIONAL)

# --- interoperability -------------------------------------------------------------------
add(
    "IU-01-01",
    "CASE WHEN connections + external_locations = 0 THEN 'open'"
    " WHEN adhoc_statements = 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        connections=rows("x_connections"),
        external_locations=rows("x_external_locations"),
        storage_credentials=rows("x_storage_credentials"),
        adhoc_statements=rows(
            "x_queries",
            "regexp_matches(text, 'jdbc:(mysql|postgres|sqlserver|oracle)') OR"
            " text LIKE '%fs.azure.account.key%' OR text LIKE '%aws_secret_access_key%'",
        ),
    ),
)
add(
    "IU-01-02",
    signals("autoloader", "managed_ingestion", "federation", "zerobus"),
    fields(
        autoloader=FILES,
        managed_ingestion=INGESTION,
        federation=rows("x_connections"),
        zerobus=rows("x_zerobus_stream"),
    ),
)
ALL_CLIENTS = (
    "SELECT client_application AS key, count(*) AS n FROM x_queries"
    " WHERE client_application IS NOT NULL GROUP BY 1"
)
CLIENTS = f"{ALL_CLIENTS} ORDER BY n DESC, key LIMIT 10"
PARTNERS = (
    "tableau|power bi|powerbi|looker|qlik|sigma|thoughtspot|dbt|fivetran|informatica|talend"
    "|matillion|alteryx|sap|collibra|alation|atlan|hightouch|census|airbyte|excel|datadog|hex"
    "|streamlit|mode|preset|superset"
)
add(
    "IU-01-03",
    "CASE WHEN attributed_queries = 0 THEN 'open' WHEN partners = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    fields(
        partners=one("count(*)", f"({ALL_CLIENTS}) WHERE regexp_matches(lower(key), '{PARTNERS}')"),
        partner_queries=one(
            "CAST(coalesce(sum(n), 0) AS BIGINT)",
            f"({ALL_CLIENTS}) WHERE regexp_matches(lower(key), '{PARTNERS}')",
        ),
        attributed_queries=one("CAST(coalesce(sum(n), 0) AS BIGINT)", f"({ALL_CLIENTS})"),
    ),
)
add(
    "IU-01-04",
    RATIO,
    "SELECT *, pipelines + jobs - complex_jobs AS numerator, pipelines + jobs AS denominator"
    " FROM ("
    + fields(
        pipelines=PIPELINES,
        jobs=JOBS,
        complex_jobs=one(
            "count(*)",
            "(SELECT job_id FROM x_job_tasks WHERE delete_time IS NULL GROUP BY job_id"
            " HAVING count(*) > 20)",
        ),
    )
    + ")",
)
OPEN_FORMATS = "'delta','deltasharing','parquet','iceberg','avro','orc','csv','json','text'"
add(
    "IU-02-01",
    RATIO,
    over(
        "x_tables",
        BASE,
        numerator=n(f"lower(coalesce(data_source_format, '')) IN ({OPEN_FORMATS})"),
        denominator="count(*)",
        open_table_formats=n(
            "lower(coalesce(data_source_format, '')) IN ('delta', 'deltasharing', 'iceberg')"
        ),
    ),
)
add(
    "IU-02-02",
    "CASE WHEN shares = 0 AND recipients = 0 THEN 'open'"
    " WHEN shares > 0 AND shared_tables > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        shares=rows("x_shares"),
        recipients=f"coalesce({inventory('recipients')}, 0)",
        shared_tables=rows("x_table_share_usage"),
        ip_restricted_recipients=one(
            "count(DISTINCT recipient_name)", "x_recipient_allowed_ip_ranges"
        ),
    ),
)
add(
    "IU-02-03",
    "CASE WHEN runs = 0 AND experiments = 0 AND endpoints = 0 THEN 'open'"
    " WHEN runs > 0 OR experiments > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        runs=RUNS,
        experiments=EXPERIMENTS,
        endpoints=one("count(DISTINCT endpoint_id)", "x_live_served"),
    ),
)
add(
    "IU-03-01",
    "CASE WHEN active_principals = 0 THEN 'open'"
    " WHEN coalesce(policies, 0) > 0 AND principals_with_grants > 0 THEN 'completed'"
    " ELSE 'in-progress' END",
    fields(
        active_principals=one("count(DISTINCT executed_by)", "x_queries"),
        policies=inventory("cluster_policies"),
        principals_with_grants=one(
            "count(DISTINCT grantee)",
            "x_schema_privileges WHERE lower(privilege_type) IN"
            " ('select', 'use_schema', 'usage')",
        ),
    ),
)


def whole(total: str) -> str:
    return f"CAST(round_even({total}, 0) AS BIGINT)"


def usage_share(part: str, total: str = "sum(usage_quantity)") -> dict[str, str]:
    return {
        "numerator": whole(f"coalesce({part}, 0)"),
        "denominator": f"CASE WHEN {total} > 0 THEN {whole(total)} ELSE 0 END",
    }


def amount(where: str) -> str:
    return f"sum(CASE WHEN {where} THEN usage_quantity ELSE 0 END)"


SERVERLESS = amount("on_serverless")
SERVERLESS_SHARE = over(
    "x_recent_usage",
    **usage_share(SERVERLESS),
    serverless_dbus=f"round({SERVERLESS}, 2)",
    total_dbus="round(sum(usage_quantity), 2)",
)
add(
    "IU-03-02",
    RATIO,
    over(
        "x_recent_usage",
        **usage_share(SERVERLESS),
        serverless_dbus=f"round({SERVERLESS}, 2)",
        total_dbus="round(sum(usage_quantity), 2)",
        serverless_products=(
            "count(DISTINCT CASE WHEN coalesce(is_serverless, FALSE)"
            " THEN billing_origin_product END)"
        ),
    ),
)
GOVERNED_CLUSTERS = n("policy_id IS NOT NULL AND policy_id <> ''")


def by_presence(otherwise: str = RATIO) -> str:
    return (
        "CASE WHEN denominator = 0 AND coalesce(policies, 0) > 0 THEN 'completed'"
        f" ELSE {otherwise} END"
    )


add(
    "IU-03-03",
    by_presence(),
    over(
        "x_latest_clusters",
        numerator=GOVERNED_CLUSTERS,
        denominator="count(*)",
        templated_clusters=GOVERNED_CLUSTERS,
        policies=inventory("cluster_policies"),
    ),
)
add(
    "IU-03-04",
    signals("assistant_events", "ai_function_calls", "genie_queries"),
    fields(
        assistant_events=rows("x_assistant_events", f"event_time >= {WINDOW_TIME}"),
        ai_function_calls=rows(
            "x_queries",
            "regexp_matches(text, 'ai_(query|classify|extract|gen|summarize|translate"
            "|fix_grammar|similarity|forecast|parse_document|analyze_sentiment|mask)\\s*\\(')",
        ),
        genie_queries=rows("x_queries", "genie_space_id IS NOT NULL"),
    ),
)
add(
    "IU-04-01",
    RATIO,
    over(
        "x_tables",
        BASE,
        numerator=n(f"{filled('comment')} AND {filled('table_owner')}"),
        denominator="count(*)",
        certified_tables=one(
            f"count(DISTINCT {TRIPLE2})",
            f"x_table_tags WHERE {S2} AND (regexp_matches(lower(tag_name),"
            " '(certif|product|gold|trusted|sla)') OR regexp_matches(lower(tag_value),"
            " '(certif|product|gold|trusted)'))",
        ),
    ),
)
VIEWS_IN_SCOPE = rows("x_tables", f"{S} AND table_type = 'VIEW'")
add(
    "IU-04-02",
    _ratio(0.3),
    "SELECT *, least(views + metric_views + functions, views + tables) AS numerator,"
    " views + tables AS denominator FROM ("
    + fields(
        views=VIEWS_IN_SCOPE,
        metric_views=rows(
            "x_tables", f"{S} AND lower(coalesce(table_type, '')) LIKE '%metric%'"
        ),
        functions=ROUTINES,
        tables=TABLES,
    )
    + ")",
)
add(
    "IU-04-03",
    RATIO,
    "SELECT *, uc_tables AS numerator, uc_tables + hive_metastore_tables AS denominator FROM ("
    + fields(
        column_lineage_events=rows("x_column_lineage", f"event_date >= {WINDOW_DAY}"),
        hive_metastore_tables=LEGACY,
        uc_tables=TABLES,
    )
    + ")",
)

# --- operations --------------------------------------------------------------------------
DEPLOYED = n("deployment_kind IS NOT NULL")
add(
    "OE-01-02",
    "CASE WHEN coalesce(repos, 0) = 0 AND coalesce(git_credentials, 0) = 0"
    " AND git_backed_jobs = 0 THEN 'open' WHEN denominator > 0 THEN "
    f"({RATIO}) ELSE 'in-progress' END",
    over(
        "x_latest_jobs",
        numerator=DEPLOYED,
        denominator="count(*)",
        git_backed_jobs=DEPLOYED,
        repos=inventory("repos"),
        git_credentials=inventory("git_credentials"),
    ),
)
add(
    "OE-01-03",
    RATIO,
    over(
        "x_latest_jobs",
        numerator=DEPLOYED,
        denominator="count(*)",
        bundle_deployed_jobs=DEPLOYED,
    ),
)
add(
    "OE-01-04",
    "CASE WHEN uc_models = 0 AND experiments = 0 AND runs = 0 THEN 'open'"
    " WHEN uc_models = 0 THEN 'in-progress' ELSE 'completed' END",
    fields(
        uc_models=f"coalesce({inventory('registered_models')}, 0)",
        experiments=EXPERIMENTS,
        runs=RUNS,
    ),
)
TIERS = "CAST(prod > 0 AS INT) + CAST(dev > 0 AS INT) + CAST(test > 0 AS INT)"
add(
    "OE-01-05",
    f"CASE WHEN {TIERS} = 0 THEN 'open' WHEN prod > 0 AND {TIERS} >= 2 THEN 'completed'"
    " ELSE 'in-progress' END",
    over(
        "x_own_catalogs",
        prod=n("regexp_matches(lower(catalog_name), 'prod|prd')"),
        dev=n("regexp_matches(lower(catalog_name), 'dev|sandbox')"),
        test=n("regexp_matches(lower(catalog_name), 'test|qa|stag|uat')"),
        catalogs="count(*)",
        workspaces=WORKSPACES,
    ),
)
add(
    "OE-01-06",
    "CASE WHEN endpoints = 0 THEN 'open' WHEN external + foundation = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    over(
        "x_live_served",
        endpoints="count(DISTINCT endpoint_id)",
        external=n("entity_type = 'EXTERNAL_MODEL'"),
        foundation=n("entity_type = 'FOUNDATION_MODEL'"),
        providers=(
            "count(DISTINCT CASE WHEN entity_type = 'EXTERNAL_MODEL' THEN provider END)"
        ),
        gateway_requests=rows("x_gateway", f"request_time >= {WINDOW_TIME}"),
    ),
)
add(
    "OE-01-07",
    RATIO,
    over(
        "x_own_catalogs",
        numerator=n(filled("comment")),
        denominator="count(*)",
        catalogs="count(*)",
        owned=n(filled("catalog_owner")),
        hive_metastore_tables=rows("x_tables", "lower(table_catalog) = 'hive_metastore'"),
    ),
)
SCORES = (
    "toxicity|relevance|faithful|correctness|groundedness|answer_{extra}|judge"
)


def scores(extra: str) -> str:
    words = SCORES.format(extra=extra)
    return rows(
        "x_run_metrics_history",
        f"metric_time >= {WINDOW_TIME} AND"
        f" regexp_matches(lower(coalesce(metric_name, '')), '({words})')",
    )


add(
    "OE-01-08",
    "CASE WHEN evaluation_runs = 0 AND quality_metrics = 0 THEN 'open'"
    " WHEN quality_metrics > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        evaluation_runs=rows(
            "x_live_runs",
            "regexp_matches(lower(coalesce(run_name, '')), '(eval|judge|benchmark)') OR"
            " regexp_matches(lower(coalesce(tag_value, '')),"
            " '(evaluation|mlflow.evaluate|judge)')",
        ),
        quality_metrics=scores("|rouge|bleu"),
    ),
)
add(
    "OE-02-01",
    RATIO,
    over(
        "x_latest_jobs",
        numerator=DEPLOYED,
        denominator="count(*)",
        iac_jobs=DEPLOYED,
        terraform_api_calls=rows(
            "x_recent_audit",
            "regexp_matches(lower(coalesce(user_agent, '')), '(terraform|pulumi|cdk)')",
        ),
    ),
)
add(
    "OE-02-02",
    by_presence(),
    over(
        "x_latest_clusters",
        numerator=GOVERNED_CLUSTERS,
        denominator="count(*)",
        governed_clusters=GOVERNED_CLUSTERS,
        policies=inventory("cluster_policies"),
    ),
)
TRIGGERED = n(
    "trigger_kind IN ('schedule', 'file_arrival', 'periodic', 'table_update', 'continuous')"
)
add(
    "OE-02-03",
    RATIO,
    over(
        "x_latest_jobs",
        numerator=TRIGGERED,
        denominator="count(*)",
        triggered_jobs=TRIGGERED,
        paused_jobs=n("coalesce(paused, FALSE)"),
    ),
)
add(
    "OE-02-04",
    "CASE WHEN file_arrival_jobs + autoloader_statements + rescued_data_tables +"
    " ingestion_pipelines = 0 THEN 'open'"
    " WHEN file_arrival_jobs > 0 OR autoloader_statements > 0 THEN 'completed'"
    " ELSE 'in-progress' END",
    fields(
        file_arrival_jobs=rows("x_latest_jobs", "trigger_kind = 'file_arrival'"),
        autoloader_statements=FILES,
        rescued_data_tables=one(
            f"count(DISTINCT {TRIPLE})",
            f"x_columns WHERE {S} AND lower(column_name) = '_rescued_data'",
        ),
        ingestion_pipelines=INGESTION,
    ),
)
add(
    "OE-02-05",
    _ratio(0.3),
    "SELECT *, pipelines AS numerator, pipelines + jobs AS denominator FROM ("
    + fields(pipelines=PIPELINES, jobs=JOBS)
    + ")",
)
LEARNING = rows(
    "x_latest_jobs",
    "regexp_matches(lower(coalesce(name, '')),"
    " '(train|model|ml|feature|score|predict|inference)')",
)
add(
    "OE-02-06",
    "CASE WHEN uc_models = 0 THEN 'open' WHEN ml_jobs = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    fields(uc_models=f"coalesce({inventory('registered_models')}, 0)", ml_jobs=LEARNING),
)
add(
    "OE-02-07",
    "CASE WHEN coalesce(uc_models, 0) = 0 THEN 'open' ELSE 'completed' END",
    fields(
        uc_models=inventory("registered_models"),
        served_models=one(
            "count(DISTINCT entity_name)", "x_live_served WHERE entity_type = 'CUSTOM_MODEL'"
        ),
    ),
)
add(
    "OE-02-08",
    RATIO,
    over(
        "x_live_runs",
        numerator=n("n_metrics > 0"),
        denominator="count(*)",
        runs="count(*)",
        runs_with_metrics=n("n_metrics > 0"),
        runs_with_params=n("n_params > 0"),
    ),
)
add(
    "OE-02-09",
    "CASE WHEN runs = 0 AND ml_jobs = 0 THEN 'open' WHEN ml_jobs = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    fields(ml_jobs=LEARNING, total_jobs=JOBS, runs=RUNS),
)
add(
    "OE-02-10",
    RATIO,
    "SELECT *, least(pipelines + multi_task_jobs, pipelines + jobs) AS numerator,"
    " pipelines + jobs AS denominator FROM ("
    + fields(
        pipelines=rows("x_latest_pipelines"),
        serverless_pipelines=rows("x_latest_pipelines", "serverless"),
        multi_task_jobs=DEPENDENT,
        jobs=JOBS,
    )
    + ")",
)
add(
    "OE-02-11",
    "CASE WHEN eval_jobs = 0 AND quality_metrics = 0 AND llm_endpoints = 0 THEN 'open'"
    " WHEN eval_jobs = 0 THEN 'in-progress' ELSE 'completed' END",
    fields(
        eval_jobs=rows(
            "x_latest_jobs",
            "regexp_matches(lower(coalesce(name, '')), '(eval|judge|benchmark|quality)')",
        ),
        quality_metrics=scores(""),
        llm_endpoints=one(
            "count(DISTINCT endpoint_id)",
            "x_live_served WHERE entity_type IN ('FOUNDATION_MODEL', 'EXTERNAL_MODEL')",
        ),
    ),
)
add(
    "OE-03-01",
    f"CASE WHEN ({RATIO}) = 'completed' AND system_table_consumers = 0 THEN 'in-progress'"
    f" ELSE ({RATIO}) END",
    fields(
        numerator="CAST(5 AS BIGINT)",
        denominator="CAST(5 AS BIGINT)",
        system_table_consumers=one(
            "count(DISTINCT executed_by)",
            f"x_queries WHERE {ON_SYSTEM} AND text NOT LIKE '%information_schema%'",
        ),
    ),
)
ALERTS = one("count(DISTINCT alert_id)", "x_queries")
add(
    "OE-03-02",
    signals("dashboards", "alerts", "external_agents"),
    fields(
        dashboards=one(f"count(DISTINCT {DASHBOARD})", f"x_queries WHERE {ON_SYSTEM}"),
        alerts=ALERTS,
        external_agents=one(
            "count(DISTINCT user_agent)",
            "x_recent_audit WHERE regexp_matches(lower(coalesce(user_agent, '')),"
            " '(datadog|splunk|grafana|prometheus|newrelic|dynatrace|elastic)')",
        ),
    ),
)
add(
    "OE-03-04",
    signals("alerts", "jobs_with_health_rules", "event_driven_jobs"),
    fields(
        alerts=ALERTS,
        jobs_with_health_rules=HEALTH_RULES,
        event_driven_jobs=rows(
            "x_latest_jobs", "trigger_kind IN ('file_arrival', 'table_update')"
        ),
        jobs=rows("x_latest_jobs"),
    ),
)
add(
    "OE-04-01",
    "CASE WHEN throttle_events + queued_queries + warehouse_failures = 0 THEN 'completed'"
    " ELSE 'in-progress' END",
    fields(
        throttle_events=rows(
            "x_recent_audit",
            "regexp_matches(lower(coalesce(error_message, '')),"
            " '(quota|limit exceeded|too many requests|throttl|resource_exhausted)')"
            " OR TRY_CAST(status_code AS INT) = 429",
        ),
        queued_queries=rows("x_queries", "coalesce(waiting_at_capacity_duration_ms, 0) > 0"),
        warehouse_failures=rows(
            "x_warehouse_events",
            f"event_time >= {WINDOW_TIME} AND"
            " regexp_matches(lower(coalesce(event_type, '')), '(scaled_up_failed|failed)')",
        ),
        readable_sources="CAST(3 AS BIGINT)",
    ),
)
add(
    "OE-04-02",
    "CASE WHEN usage_days = 0 THEN 'open' WHEN forecast_queries = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    over(
        "x_usage",
        f"usage_date >= {DAY_60}",
        usage_days="count(DISTINCT usage_date)",
        recent_dbus=f"round({amount(f'usage_date >= {DAY_30}')}, 2)",
        prior_dbus=f"round({amount(f'usage_date < {DAY_30}')}, 2)",
        forecast_queries=rows(
            "x_queries",
            "text LIKE '%system.billing.usage%' AND"
            " (regexp_matches(text, '(forecast|trend|projection|budget)')"
            " OR text LIKE '%group by%')",
        ),
    ),
)

# --- reliability ---------------------------------------------------------------------------
add("R-01-01", RATIO, TRANSACTIONAL)
add(
    "R-01-02",
    "CASE WHEN clusters = 0 AND serverless_jobs = 0 THEN 'open' ELSE 'completed' END",
    fields(clusters=rows("x_latest_clusters"), serverless_jobs=SERVERLESS_JOBS),
)
add(
    "R-01-03",
    "CASE WHEN rescued_data_tables + quarantine_tables = 0 THEN 'open'"
    " WHEN rescued_data_tables + quarantine_tables < 3 THEN 'in-progress'"
    " ELSE 'completed' END",
    fields(
        rescued_data_tables=one(
            f"count(DISTINCT {TRIPLE})",
            f"x_columns WHERE {S} AND lower(column_name) IN ('_rescued_data', 'rescued_data')",
        ),
        quarantine_tables=rows(
            "x_tables",
            f"{S} AND (lower(table_name) LIKE '%quarantine%' OR lower(table_name) LIKE"
            " '%reject%' OR lower(table_name) LIKE '%_bad%' OR lower(table_name) LIKE"
            " '%invalid%' OR lower(table_name) LIKE '%_dlq%')",
        ),
        tables_scanned=TABLES,
    ),
)
TIMEOUT = rows("x_latest_jobs", "timeout_seconds IS NOT NULL AND timeout_seconds > 0")
add(
    "R-01-04",
    RATIO,
    fields(
        numerator=TIMEOUT,
        denominator=JOBS,
        jobs_with_timeout=TIMEOUT,
        jobs_with_retries=one(
            "count(DISTINCT job_id)",
            "x_recent_job_runs WHERE lower(coalesce(run_type, '')) LIKE '%retry%'",
        ),
    ),
)
add(
    "R-01-05",
    "CASE WHEN endpoints = 0 THEN 'open' ELSE 'completed' END",
    over(
        "x_live_served",
        endpoints="count(DISTINCT endpoint_id)",
        entities="count(DISTINCT served_entity_id)",
        requests=rows("x_endpoint_usage", f"request_time >= {WINDOW_TIME}"),
    ),
)
add("R-01-06", RATIO, SERVERLESS_SHARE)


def layer(words: str, prefix: str) -> str:
    return (
        f"count(DISTINCT CASE WHEN regexp_matches(lower(table_schema), '({words})') OR"
        f" regexp_matches(lower(table_name), '^({prefix})_') THEN table_schema END)"
    )


add(
    "R-02-01",
    "CASE CAST(bronze > 0 AS INT) + CAST(silver > 0 AS INT) + CAST(gold > 0 AS INT)"
    " WHEN 0 THEN 'open' WHEN 3 THEN 'completed' ELSE 'in-progress' END",
    over(
        "x_tables",
        S,
        bronze=layer("bronze|raw|landing|staging|stg", "bronze|raw"),
        silver=layer("silver|cleansed|conformed|refined|curated", "silver"),
        gold=layer("gold|mart|presentation|serving|semantic|reporting", "gold"),
        schemas="count(DISTINCT table_schema)",
    ),
)
COPY = n(
    "regexp_matches(lower(table_name),"
    " '(_copy|_bak|_backup|_old|_v[0-9]+$|_tmp|_temp|_dup|_new)$')"
)
add(
    "R-02-02",
    RATIO,
    over(
        "x_tables",
        BASE,
        numerator=f"count(*) - {COPY}",
        denominator="count(*)",
        suspect_duplicates=COPY,
        views=VIEWS_IN_SCOPE,
    ),
)
add(
    "R-02-03",
    "CASE WHEN total_columns = 0 THEN 'open'"
    " WHEN not_null_columns * 100.0 / total_columns >= 20 THEN 'completed'"
    " ELSE 'in-progress' END",
    over(
        "x_columns",
        S,
        not_null_columns=n("is_nullable = 'NO'"),
        total_columns="count(*)",
        alter_events=rows(
            "x_recent_audit",
            "service_name IN ('unityCatalog', 'notebook') AND"
            " (lower(coalesce(statement, '')) LIKE '%alter table%'"
            " OR action_name = 'updateTable')",
        ),
    ),
)
add(
    "R-02-04",
    RATIO,
    fields(numerator=CONSTRAINED, denominator=TABLES, declarative_pipelines=PIPELINES),
)
add(
    "R-02-05",
    "CASE WHEN runs = 0 THEN 'open' WHEN feature_tables > 0 THEN 'completed'"
    " ELSE 'in-progress' END",
    fields(
        runs=RUNS,
        feature_tables=one(
            f"count(DISTINCT {TRIPLE2})", "x_table_tags WHERE lower(tag_name) LIKE '%feature%'"
        ),
        lineage_entities=one(
            "count(DISTINCT entity_id)",
            "x_recent_lineage WHERE lower(coalesce(entity_type, '')) IN"
            " ('notebook', 'job', 'pipeline')",
        ),
    ),
)
AUTOSCALING = n(
    "max_autoscale_workers IS NOT NULL AND"
    " max_autoscale_workers > coalesce(min_autoscale_workers, 0)"
)
add(
    "R-03-01",
    "CASE WHEN denominator = 0 AND serverless_jobs > 0 THEN 'completed'"
    f" ELSE ({RATIO}) END",
    over(
        "x_latest_clusters",
        numerator=AUTOSCALING,
        denominator="count(*)",
        serverless_jobs=SERVERLESS_JOBS,
    ),
)
SPREADING = n("max_clusters > coalesce(min_clusters, 1)")
add("R-03-02", RATIO, over("x_latest_warehouses", numerator=SPREADING, denominator="count(*)"))
CONTINUOUS = rows("x_pipelines", "delete_time IS NULL AND continuous")
add(
    "R-04-01",
    "CASE WHEN pipelines + streaming_tables + streaming_statements = 0 THEN 'open'"
    " WHEN pipelines > 0 OR streaming_tables > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        pipelines=CONTINUOUS,
        streaming_tables=rows(
            "x_tables", f"{S} AND lower(coalesce(table_type, '')) LIKE '%streaming%'"
        ),
        streaming_statements=rows(
            "x_queries",
            "text LIKE '%readstream%' OR text LIKE '%writestream%' OR text LIKE '%stream(%'",
        ),
    ),
)
add(
    "R-04-02",
    f"CASE WHEN ({RATIO}) = 'completed' AND time_travel_statements = 0 THEN 'in-progress'"
    f" ELSE ({RATIO}) END",
    over(
        "x_tables",
        BASE,
        numerator=n("lower(coalesce(data_source_format, '')) = 'delta'"),
        denominator="count(*)",
        time_travel_statements=rows(
            "x_queries",
            "text LIKE '%version as of%' OR text LIKE '%timestamp as of%'"
            " OR text LIKE '%restore table%'",
        ),
        catalogs_with_retention=rows(
            "x_catalogs",
            "catalog_name IN (SELECT catalog_name FROM x_scope) AND"
            " custom_max_retention_hours IS NOT NULL",
        ),
    ),
)
add(
    "R-04-03",
    RATIO,
    fields(
        numerator=DEPENDENT,
        denominator=JOBS,
        jobs=JOBS,
        multi_task_jobs=DEPENDENT,
        repair_runs=rows(
            "x_recent_job_runs",
            "regexp_matches(lower(coalesce(run_type, '')), '(repair|retry)')",
        ),
    ),
)
add(
    "R-04-04",
    "CASE WHEN replication_states = 0 AND clones = 0 THEN 'open'"
    " WHEN replication_states = 0 THEN 'in-progress' ELSE 'completed' END",
    fields(
        replication_states=rows("x_states"),
        clones=one(
            "count(DISTINCT table_id)",
            f"x_table_metrics_history WHERE snapshot_date >= {DAY_30} AND cloned",
        ),
        shares=rows("x_shares"),
        workspaces=WORKSPACES,
    ),
)
SUCCEEDED = n("result_state = 'SUCCEEDED'")
ENDED = "x_recent_job_runs WHERE result_state IS NOT NULL"
add(
    "R-05-01",
    f"CASE WHEN runs = 0 THEN 'open' ELSE ({RATIO}) END",
    fields(
        numerator=HEALTH_RULES,
        denominator=JOBS,
        runs=one("count(*)", ENDED),
        failed=one(
            "count(*)", ENDED + " AND result_state IN ('FAILED', 'TIMEDOUT', 'INTERNAL_ERROR')"
        ),
        success_rate_pct=one(
            f"round({SUCCEEDED}"
            " * 100.0::DOUBLE / count(*), 2)",
            ENDED,
        ),
        jobs_with_health_rules=HEALTH_RULES,
    ),
)
add(
    "R-05-02",
    signals("node_timeline_rows", "instance_events", "outbound_network_events"),
    fields(
        node_timeline_rows=rows("x_node_timeline", f"start_time >= {TIME_7}"),
        instance_events=rows("x_instance_events", f"event_time >= {WINDOW_TIME}"),
        outbound_network_events=rows("x_outbound_network", f"event_time >= {WINDOW_TIME}"),
    ),
)

# --- performance ---------------------------------------------------------------------------
add("PE-01-01", RATIO, SERVERLESS_SHARE)
add(
    "PE-01-02",
    "CASE WHEN endpoints = 0 THEN 'open' ELSE 'completed' END",
    over(
        "x_live_served",
        endpoints="count(DISTINCT endpoint_id)",
        foundation=n("entity_type = 'FOUNDATION_MODEL'"),
        external=n("entity_type = 'EXTERNAL_MODEL'"),
        custom=n("entity_type = 'CUSTOM_MODEL'"),
        provisioned_throughput=n(
            "entity_type = 'FOUNDATION_MODEL' AND max_throughput IS NOT NULL"
        ),
    ),
)


def total(column: str) -> str:
    return f"CAST(sum(coalesce({column}, 0)) AS BIGINT)"


add(
    "PE-02-01",
    _ratio(0.5),
    over(
        "x_queries",
        "done",
        numerator=total("pruned_files"),
        denominator=f"{total('pruned_files')} + {total('read_files')}",
        queries="count(*)",
        pruned_files=total("pruned_files"),
        read_files=total("read_files"),
    ),
)
PARALLEL = n("coalesce(read_partitions, 0) > 1")
add(
    "PE-02-02",
    RATIO,
    over(
        "x_queries",
        "done AND coalesce(read_bytes, 0) > 0",
        numerator=PARALLEL,
        denominator="count(*)",
        queries="count(*)",
        parallel_queries=PARALLEL,
    ),
)
add(
    "PE-02-03",
    RATIO,
    "SELECT *, exec_ms AS numerator, CASE WHEN total_ms > 0 THEN total_ms ELSE 0 END"
    " AS denominator, CASE greatest(wait_ms, compile_ms, fetch_ms) WHEN wait_ms THEN 'waiting'"
    " WHEN compile_ms THEN 'compilation' ELSE 'result fetch' END AS worst_phase FROM ("
    + over(
        "x_queries",
        "done",
        queries="count(*)",
        total_ms=total("total_duration_ms"),
        exec_ms=total("execution_duration_ms"),
        wait_ms=(
            f"{total('waiting_for_compute_duration_ms')} +"
            f" {total('waiting_at_capacity_duration_ms')}"
        ),
        compile_ms=total("compilation_duration_ms"),
        fetch_ms=total("result_fetch_duration_ms"),
    )
    + ")",
)
WORKERS = "coalesce(max_autoscale_workers, worker_count, 0)"


def none_is_good(otherwise: str = RATIO) -> str:
    return f"CASE WHEN denominator = 0 THEN 'completed' ELSE ({otherwise}) END"


add(
    "PE-02-04",
    none_is_good(),
    over(
        "x_latest_clusters",
        numerator=n(f"{WORKERS} >= 2"),
        denominator="count(*)",
        single_node=n(f"{WORKERS} = 0"),
        avg_workers=f"round(avg({WORKERS}), 2)",
    ),
)
DEFINING = n(
    "regexp_matches(coalesce(text, ''),"
    " '(create +(or +replace +)?(temporary +)?function|py_udf|pandas_udf)')"
)
SCOPED_ROUTINES = in_scope("routine_catalog", "routine_schema")
FOREIGN = "lower(coalesce(external_language, '')) IN ('python', 'scala', 'java')"
add(
    "PE-02-05",
    RATIO,
    over(
        "x_queries",
        numerator=f"count(*) - {DEFINING}",
        denominator="count(*)",
        udf_definition_statements=DEFINING,
        python_routines=rows("x_routines", f"{SCOPED_ROUTINES} AND {FOREIGN}"),
        sql_routines=rows("x_routines", f"{SCOPED_ROUTINES} AND NOT {FOREIGN}"),
    ),
)
add(
    "PE-02-06",
    RATIO,
    "SELECT CAST(round_even(least(greatest(photon_dbus, 0) + greatest(sql_dbus - photon_dbus, 0),"
    " total_dbus), 0) AS BIGINT) AS numerator, CASE WHEN total_dbus > 0 THEN"
    " CAST(round_even(total_dbus, 0) AS BIGINT) ELSE 0 END AS denominator,"
    " round(photon_dbus, 2) AS photon_dbus, round(sql_dbus, 2) AS sql_dbus,"
    " round(total_dbus, 2) AS total_dbus FROM ("
    + over(
        "x_recent_usage",
        photon_dbus=amount("is_photon"),
        sql_dbus=amount("sku LIKE '%sql%'"),
        total_dbus="sum(usage_quantity)",
    )
    + ")",
)
NODES = over(
    "x_node_timeline",
    f"start_time >= {TIME_30}",
    clusters="count(DISTINCT cluster_id)",
    avg_cpu_pct="round(avg(cpu_user_percent + cpu_system_percent), 2)",
    avg_mem_pct="round(avg(mem_used_percent), 2)",
    avg_iowait_pct="round(avg(coalesce(cpu_wait_percent, 0)), 2)",
    avg_swap_pct="round(avg(coalesce(mem_swap_percent, 0)), 2)",
)
NODE_LIMITS = over(
    "x_node_timeline",
    f"start_time >= {TIME_30}",
    bad=(
        "avg(coalesce(mem_swap_percent, 0)) > 1 OR avg(coalesce(cpu_wait_percent, 0)) > 20 OR"
        " avg(mem_used_percent) > 90 OR avg(cpu_user_percent + cpu_system_percent) < 20"
    ),
)
add(
    "PE-02-07",
    f"CASE WHEN clusters = 0 THEN 'open' WHEN ({NODE_LIMITS}) THEN 'in-progress'"
    " ELSE 'completed' END",
    NODES,
)
add(
    "PE-02-08",
    "CASE WHEN queries = 0 THEN 'open' WHEN avg_io_cache_pct >= 50 THEN 'completed'"
    " ELSE 'in-progress' END",
    over(
        "x_queries",
        "done",
        queries="count(*)",
        avg_io_cache_pct="round(avg(coalesce(read_io_cache_percent, 0)), 2)",
        result_cache_hits=n("from_result_cache"),
    ),
)
OPERATIONS = "x_predictive_optimization_operations_history"
add(
    "PE-02-09",
    "CASE WHEN po_operations = 0 AND manual_optimize = 0 THEN 'open'"
    " WHEN po_operations > 0 THEN 'completed' ELSE 'in-progress' END",
    over(
        OPERATIONS,
        f"start_time >= {WINDOW_TIME}",
        po_operations="count(*)",
        po_tables="count(DISTINCT table_id)",
        manual_optimize=rows("x_queries", "regexp_matches(text, '^\\s*optimize ')"),
    ),
)
add(
    "PE-02-10",
    _ratio(0.5),
    over(
        "x_queries",
        "done AND coalesce(read_files, 0) + coalesce(pruned_files, 0) > 0",
        numerator=total("pruned_files"),
        denominator=f"{total('pruned_files')} + {total('read_files')}",
        queries="count(*)",
        pruned_files=total("pruned_files"),
        read_files=total("read_files"),
        clustering_statements=rows(
            "x_queries", "text LIKE '%cluster by%' OR text LIKE '%zorder%'"
        ),
    ),
)
add(
    "PE-02-11",
    RATIO,
    over(
        "x_latest_storage",
        numerator=n(
            "regexp_matches(lower(coalesce(predictive_optimization_enabled, '')),"
            " '(enable|inherit|true)')"
        ),
        denominator="count(*)",
    ),
)
add(
    "PE-02-12",
    RATIO,
    "SELECT count(*) - count(*) FILTER (WHERE parts > 2) AS numerator, count(*) AS denominator,"
    " count(*) FILTER (WHERE parts = 0) AS unpartitioned,"
    " count(*) FILTER (WHERE parts BETWEEN 1 AND 2) AS lightly_partitioned,"
    " count(*) FILTER (WHERE parts > 2) AS heavily_partitioned, "
    + rows("x_latest_storage", "coalesce(active_bytes, 0) BETWEEN 1 AND 1073741824")
    + " AS small_tables FROM (SELECT count(partition_index) AS parts FROM x_columns WHERE "
    + S
    + " GROUP BY table_catalog, table_schema, table_name)",
)
FILE_BYTES = "CAST(active_bytes AS DOUBLE) / active_files"
add(
    "PE-02-14",
    RATIO,
    over(
        "x_latest_storage",
        "coalesce(active_files, 0) > 0",
        numerator=n(f"{FILE_BYTES} >= 16777216"),
        denominator="count(*)",
        small_file_tables=n(f"{FILE_BYTES} < 16777216"),
        avg_file_mb=f"round(avg({FILE_BYTES}) / 1048576, 2)",
    ),
)
SPILLING = n("coalesce(spilled_local_bytes, 0) > 0")
add(
    "PE-02-15",
    RATIO,
    over(
        "x_queries",
        "done AND coalesce(text, '') LIKE '% join %'",
        numerator=f"count(*) - {SPILLING}",
        denominator="count(*)",
        join_queries="count(*)",
        spilling_queries=SPILLING,
        shuffle_bytes=total("shuffle_read_bytes"),
        read_bytes=total("read_bytes"),
    ),
)
add(
    "PE-02-16",
    "CASE WHEN analyze_statements = 0 AND po_statistics_operations = 0 THEN 'open'"
    " WHEN po_statistics_operations > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        analyze_statements=rows("x_queries", "regexp_matches(text, 'analyze +table')"),
        po_statistics_operations=rows(
            OPERATIONS,
            f"start_time >= {WINDOW_TIME} AND regexp_matches(lower(coalesce(operation_type,"
            " '')), '(analyze|statistic|compute_stats)')",
        ),
    ),
)
COLD = n("coalesce(waiting_for_compute_duration_ms, 0) > 10000")
add(
    "PE-03-02",
    RATIO,
    over(
        "x_queries",
        "done",
        numerator=f"count(*) - {COLD}",
        denominator="count(*)",
        cold_start_queries=COLD,
        wait_ms=total("waiting_for_compute_duration_ms"),
        total_ms=total("total_duration_ms"),
    ),
)
add(
    "PE-03-03",
    RATIO,
    "SELECT *, greatest(queries - greatest(spilling, shuffle_heavy, queued), 0) AS numerator,"
    " queries AS denominator FROM ("
    + over(
        "x_queries",
        "done",
        queries="count(*)",
        spilling=SPILLING,
        shuffle_heavy=n(
            "coalesce(shuffle_read_bytes, 0) > coalesce(read_bytes, 0) AND"
            " coalesce(read_bytes, 0) > 0"
        ),
        queued=n("coalesce(waiting_at_capacity_duration_ms, 0) > 0"),
    )
    + ")",
)
add(
    "PE-04-01",
    "CASE WHEN history_days = 0 THEN 'open' WHEN monitoring_queries = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    over(
        "x_queries",
        history_days="count(DISTINCT CAST(start_time AS DATE))",
        monitoring_queries=n("text LIKE '%system.query.history%'"),
    ),
)
add(
    "PE-04-02",
    "CASE WHEN continuous_pipelines = 0 AND pipeline_updates = 0 THEN 'open'"
    " WHEN pipeline_updates > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        continuous_pipelines=CONTINUOUS,
        pipeline_updates=rows(
            "x_pipeline_update_timeline", f"update_start_time >= {WINDOW_TIME}"
        ),
    ),
)
add(
    "PE-04-03",
    f"CASE WHEN runs = 0 THEN 'open' ELSE ({RATIO}) END",
    fields(
        numerator=HEALTH_RULES,
        denominator=JOBS,
        runs=one("count(*)", ENDED),
        jobs_run=one("count(DISTINCT job_id)", ENDED),
        jobs_with_health_rules=HEALTH_RULES,
    ),
)

# --- cost ----------------------------------------------------------------------------------
add("CO-01-01", RATIO, TRANSACTIONAL)
ALL_PURPOSE = amount("sku LIKE '%all_purpose%'")
add(
    "CO-01-02",
    RATIO,
    over(
        "x_recent_usage",
        "product NOT IN ('sql')",
        **usage_share(f"sum(usage_quantity) - {ALL_PURPOSE}"),
        all_purpose_dbus=f"round({ALL_PURPOSE}, 2)",
        total_dbus="round(sum(usage_quantity), 2)",
    ),
)
add(
    "CO-01-03",
    RATIO,
    over(
        "x_queries",
        "statement_type = 'SELECT'",
        numerator=n("lower(coalesce(compute_type, '')) LIKE '%warehouse%'"),
        denominator="count(*)",
    ),
)
MAJOR = "TRY_CAST(regexp_extract(coalesce(dbr_version, ''), '^([0-9]+)', 1) AS INT)"
add(
    "CO-01-04",
    none_is_good(),
    over(
        "x_latest_clusters",
        numerator=n(f"{MAJOR} >= 14"),
        denominator="count(*)",
        oldest_dbr_major=f"CAST(min({MAJOR}) AS BIGINT)",
        threshold_major="CAST(14 AS BIGINT)",
    ),
)
GPU = amount("regexp_matches(sku, '(gpu|ml.*gpu)')")
add(
    "CO-01-05",
    "CASE WHEN coalesce(total_dbus, 0) <= 0 THEN 'open' WHEN gpu_dbus = 0 OR mlflow_runs > 0"
    " THEN 'completed' ELSE 'in-progress' END",
    over(
        "x_recent_usage",
        gpu_dbus=f"round({GPU}, 2)",
        total_dbus="round(sum(usage_quantity), 2)",
        gpu_share_pct=f"round({GPU} * 100 / sum(usage_quantity), 2)",
        mlflow_runs=RUNS,
    ),
)
add("CO-01-06", RATIO, SERVERLESS_SHARE)
ALL_NODE_TYPES = (
    "SELECT coalesce(worker_node_type, 'unknown') AS key, count(*) AS n FROM x_latest_clusters"
    " GROUP BY 1"
)
NODE_TYPES = f"{ALL_NODE_TYPES} ORDER BY n DESC, key LIMIT 8"
add(
    "CO-01-07",
    none_is_good(),
    "SELECT CAST(coalesce(sum(n) FILTER (WHERE regexp_matches(lower(key),"
    " 'd3|d4|e4|d5|e5|m5|m6|r5|r6|c5|c6|i3en|i4|n2|e2|c3|m7|r7|c7')), 0) AS BIGINT)"
    f" AS numerator, CAST(coalesce(sum(n), 0) AS BIGINT) AS denominator FROM ({ALL_NODE_TYPES})",
)
add(
    "CO-01-08",
    "CASE WHEN clusters = 0 THEN 'open' WHEN avg_cpu_pct BETWEEN 20 AND 85 THEN 'completed'"
    " ELSE 'in-progress' END",
    f"SELECT clusters, avg_cpu_pct, avg_mem_pct FROM ({NODES})",
)
VECTORIZED = amount("is_photon OR sku LIKE '%photon%' OR sku LIKE '%sql%'")
add(
    "CO-01-09",
    RATIO,
    over(
        "x_recent_usage",
        **usage_share(VECTORIZED),
        vectorized_dbus=f"round({VECTORIZED}, 2)",
        total_dbus="round(sum(usage_quantity), 2)",
    ),
)
add(
    "CO-02-01",
    RATIO,
    "SELECT *, clusters_autoscaling + warehouses_scaling AS numerator,"
    " clusters_total + warehouses_total AS denominator FROM ("
    + fields(
        clusters_autoscaling=one(AUTOSCALING, "x_latest_clusters"),
        clusters_total=rows("x_latest_clusters"),
        warehouses_scaling=one(SPREADING, "x_latest_warehouses"),
        warehouses_total=rows("x_latest_warehouses"),
    )
    + ")",
)
INTERACTIVE = "lower(coalesce(cluster_source, '')) NOT IN ('job', 'pipeline')"
add(
    "CO-02-02",
    RATIO,
    "SELECT clusters_with_autotermination, clusters_over_120min, warehouses_with_autostop,"
    " clusters_with_autotermination + warehouses_with_autostop AS numerator,"
    " clusters + warehouses AS denominator FROM ("
    + fields(
        clusters_with_autotermination=rows(
            "x_latest_clusters", f"{INTERACTIVE} AND auto_termination_minutes > 0"
        ),
        clusters_over_120min=rows(
            "x_latest_clusters", f"{INTERACTIVE} AND auto_termination_minutes > 120"
        ),
        warehouses_with_autostop=rows("x_latest_warehouses", "auto_stop_minutes > 0"),
        clusters=rows("x_latest_clusters", INTERACTIVE),
        warehouses=rows("x_latest_warehouses"),
    )
    + ")",
)
add(
    "CO-02-03",
    by_presence(),
    over(
        "x_latest_clusters",
        numerator=GOVERNED_CLUSTERS,
        denominator="count(*)",
        governed_clusters=GOVERNED_CLUSTERS,
        policies=inventory("cluster_policies"),
    ),
)
add(
    "CO-03-01",
    "CASE WHEN usage_days = 0 THEN 'open' WHEN billing_queries = 0 THEN 'in-progress'"
    " ELSE 'completed' END",
    fields(
        usage_days=one("count(DISTINCT usage_date)", "x_recent_usage"),
        billing_queries=rows("x_queries", "text LIKE '%system.billing.usage%'"),
        consumers=one(
            "count(DISTINCT executed_by)", "x_queries WHERE text LIKE '%system.billing.usage%'"
        ),
    ),
)
add(
    "CO-03-02",
    RATIO,
    over("x_recent_usage", numerator=n("tag_key IS NOT NULL"), denominator="count(*)"),
)
BILLING_DASHBOARDS = one(f"count(DISTINCT {DASHBOARD})", f"x_queries WHERE {ON_BILLING}")
add(
    "CO-03-03",
    RATIO,
    over(
        "x_recent_usage",
        numerator=n(
            "regexp_matches(lower(tag_key),"
            " '(cost|team|project|owner|business|dept|department|bu|chargeback|env)')"
        ),
        denominator="count(*)",
        billing_dashboards=BILLING_DASHBOARDS,
        list_prices_available="TRUE",
    ),
)
add(
    "CO-03-04",
    "CASE WHEN billing_dashboards = 0 AND billing_alerts = 0 THEN 'open'"
    " WHEN billing_alerts > 0 THEN 'completed' ELSE 'in-progress' END",
    fields(
        billing_dashboards=BILLING_DASHBOARDS,
        billing_alerts=one("count(DISTINCT alert_id)", f"x_queries WHERE {ON_BILLING}"),
    ),
)
add(
    "CO-03-05",
    "CASE WHEN shares = 0 AND recipients = 0 THEN 'completed'"
    " WHEN egress_records = 0 THEN 'in-progress' ELSE 'completed' END",
    fields(
        shares=rows("x_shares"),
        recipients=f"coalesce({inventory('recipients')}, 0)",
        egress_records=rows(
            "x_recent_usage",
            "sku LIKE '%internet%' OR sku LIKE '%egress%' OR product LIKE '%sharing%'",
        ),
        materializations=rows("x_materialization_history"),
    ),
)
add(
    "CO-04-01",
    RATIO,
    "SELECT *, pipelines - continuous_pipelines AS triggered_pipelines,"
    " pipelines - continuous_pipelines AS numerator, pipelines AS denominator FROM ("
    + fields(
        pipelines=rows("x_latest_pipelines"),
        continuous_pipelines=rows("x_latest_pipelines", "continuous"),
        continuous_jobs=rows(
            "x_latest_jobs", "trigger_kind = 'continuous' AND continuous_enabled"
        ),
        development_pipelines=rows("x_latest_pipelines", "development"),
    )
    + ")",
)
SPOT = n(
    "coalesce(TRY_CAST(first_on_demand AS INT), 999) < 999"
    " OR lower(coalesce(azure_kind, '')) LIKE '%spot%'"
    " OR lower(coalesce(gcp_kind, '')) LIKE '%preemptible%'"
)
add(
    "CO-04-02",
    none_is_good(),
    over(
        "x_latest_clusters",
        numerator=SPOT,
        denominator="count(*)",
        spot_aware_clusters=SPOT,
    ),
)

# Helper columns that only the status needs.
HIDDEN = {"CO-04-01": ("pipelines",)}


def shown(question_id: str) -> str:
    body = BODIES[question_id]
    if question_id in HIDDEN:
        body = f"SELECT * EXCLUDE ({', '.join(HIDDEN[question_id])}) FROM ({body})"
    return body


def question_sql(question_id: str) -> str:
    return with_views(shown(question_id))


MIXES = {
    "formats": (
        "SELECT coalesce(data_source_format, 'UNKNOWN') AS key, count(*) AS n FROM x_tables"
        f" WHERE {BASE} GROUP BY 1 ORDER BY n DESC, key LIMIT 5"
    ),
    "closed_formats": (
        "SELECT coalesce(data_source_format, 'UNKNOWN') AS key, count(*) AS n FROM x_tables"
        f" WHERE {BASE} AND lower(coalesce(data_source_format, '')) NOT IN ({OPEN_FORMATS})"
        " GROUP BY 1 ORDER BY n DESC, key LIMIT 5"
    ),
    "unsafe_formats": (
        "SELECT coalesce(data_source_format, 'UNKNOWN') AS key, count(*) AS n FROM x_tables"
        f" WHERE {BASE} AND lower(coalesce(data_source_format, '')) NOT IN"
        " ('delta', 'deltasharing') GROUP BY 1 ORDER BY n DESC, key LIMIT 5"
    ),
    "constraint_kinds": (
        "SELECT constraint_type AS key, count(*) AS n FROM x_table_constraints"
        f" WHERE {S} GROUP BY 1 ORDER BY n DESC, key"
    ),
    "clients": CLIENTS,
    "tag_keys": (
        "SELECT tag_key AS key, count(*) AS n FROM x_recent_usage WHERE tag_key IS NOT NULL"
        " GROUP BY 1 ORDER BY n DESC, key LIMIT 8"
    ),
    "node_types": NODE_TYPES,
}


def mix_sql(name: str) -> str:
    return with_views(MIXES[name])
