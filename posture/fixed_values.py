"""Names, word lists, patterns and limits the measurements test for.

They are facts about the telemetry and the grading scheme, stated as they are.
"""

# --- statuses, in report order ------------------------------------------------
OPEN = "open"
IN_PROGRESS = "in-progress"
MANUAL = "manual-review"
COMPLETED = "completed"
STATUS_RANK = {OPEN: 0, IN_PROGRESS: 1, MANUAL: 2, COMPLETED: 3}

# --- scope: LIKE patterns -------------------------------------------------------
PRODUCTION_CATALOGS = ("prod%", "main", "%_prod", "%_production")
EXCLUDED_SCHEMAS = ("%dev%", "%test%", "%sandbox%", "%tmp%", "%scratch%")
SYSTEM_CATALOGS = ("system", "samples", r"\_\_%internal%")
LEGACY_CATALOG = "hive_metastore"

# --- identifiers that vary by platform (see README, "Settings") ------------------
# Services by name, or any whose name ends in "sql"; products by name or by ending.
SCHEMA_SERVICES = ("unityCatalog", "notebook", "%sql")
SQL_PRODUCTS = ("sql", r"%\_sql")

# --- storage formats ------------------------------------------------------------
TRANSACTIONAL_FORMATS = ("delta", "deltasharing")
OPEN_TABLE_FORMATS = ("delta", "deltasharing", "iceberg")
OPEN_FORMATS = ("delta", "deltasharing", "parquet", "iceberg", "avro", "orc", "csv", "json", "text")

# --- names of tables, schemas, catalogs and jobs ---------------------------------
RESCUE_COLUMNS = ("_rescued_data", "rescued_data")
QUARANTINE_NAMES = ("%quarantine%", "%reject%", "%_bad%", "%invalid%", "%_dlq%")
DUPLICATE_NAME = r"(_copy|_bak|_backup|_old|_v[0-9]+$|_tmp|_temp|_dup|_new)$"
LAYERS = {
    "bronze": (("bronze", "raw", "landing", "staging", "stg"), "^(bronze|raw)_"),
    "silver": (("silver", "cleansed", "conformed", "refined", "curated"), "^(silver)_"),
    "gold": (
        ("gold", "mart", "presentation", "serving", "semantic", "reporting"),
        "^(gold)_",
    ),
}
ENVIRONMENT_TIERS = {
    "prod": ("prod", "prd"),
    "dev": ("dev", "sandbox"),
    "test": ("test", "qa", "stag", "uat"),
}
PRODUCT_TAG_NAMES = ("certif", "product", "gold", "trusted", "sla")
PRODUCT_TAG_VALUES = ("certif", "product", "gold", "trusted")
LEARNING_JOB_NAMES = ("train", "model", "ml", "feature", "score", "predict", "inference")
EVALUATION_JOB_NAMES = ("eval", "judge", "benchmark", "quality")
EVALUATION_RUN_NAMES = ("eval", "judge", "benchmark")
EVALUATION_RUN_TAGS = "(evaluation|mlflow.evaluate|judge)"
OUTPUT_COMPARISON_METRICS = (
    "toxicity", "relevance", "faithful", "correctness", "groundedness", "answer_",
    "rouge", "bleu", "judge",
)
OUTPUT_QUALITY_METRICS = (
    "toxicity", "relevance", "faithful", "correctness", "groundedness", "answer_", "judge",
)
INGESTION_PIPELINES = ("ingestion", "managed")
LINEAGE_EMITTERS = ("notebook", "job", "pipeline")
NATIVE_LANGUAGES_EXCLUDED = ("python", "scala", "java")
READ_PRIVILEGES = ("select", "use_schema", "usage")
AUTOMATED_CLUSTER_SOURCES = ("job", "pipeline")
FAILED_RUN_STATES = ("FAILED", "TIMEDOUT", "INTERNAL_ERROR")
EMPTY_JSON = ("null", "{}", "[]")

# --- statement text ----------------------------------------------------------------
LINEAGE_TEXT = "%system.access.%lineage%"
AUDIT_TEXT = "%system.access.audit%"
BILLING_TEXT = "%system.billing.usage%"
BILLING_SCHEMA_TEXT = "%system.billing%"
HISTORY_TEXT = "%system.query.history%"
SYSTEM_TEXT = "%system.%"
SCHEMA_BROWSING_TEXT = "%information_schema%"
INLINE_URL = "jdbc:(mysql|postgres|sqlserver|oracle)"
INLINE_KEYS = ("%fs.azure.account.key%", "%aws_secret_access_key%")
FILE_INGESTION_TEXT = ("%cloudfiles%", "%read_files(%")
AI_FUNCTIONS = (
    r"ai_(query|classify|extract|gen|summarize|translate|fix_grammar|similarity|forecast"
    r"|parse_document|analyze_sentiment|mask)\s*\("
)
TREND_WORDS = ("forecast", "trend", "projection", "budget")
STREAM_TEXT = ("%readstream%", "%writestream%", "%stream(%")
TIME_TRAVEL_TEXT = ("%version as of%", "%timestamp as of%", "%restore table%")
CLUSTERING_TEXT = ("%cluster by%", "%zorder%")
JOIN_TEXT = "% join %"
FUNCTION_DEFINITION = r"(create +(or +replace +)?(temporary +)?function|py_udf|pandas_udf)"
COMPACTION_STATEMENT = r"^\s*optimize "
STATISTICS_STATEMENT = "analyze +table"
STATISTICS_OPERATIONS = ("analyze", "statistic", "compute_stats")

# --- audit, agents and client applications -----------------------------------------
CODE_TOOL_AGENTS = ("terraform", "pulumi", "cdk")
OBSERVABILITY_AGENTS = (
    "datadog", "splunk", "grafana", "prometheus", "newrelic", "dynatrace", "elastic",
)
THROTTLE_MESSAGES = (
    "quota", "limit exceeded", "too many requests", "throttl", "resource_exhausted",
)
THROTTLE_STATUS = 429
SCALE_UP_FAILURES = ("scaled_up_failed", "failed")
ALTER_TEXT = "%alter table%"
ALTER_ACTION = "updateTable"
PARTNER_TOOLS = (
    "tableau", "power bi", "powerbi", "looker", "qlik", "sigma", "thoughtspot", "dbt",
    "fivetran", "informatica", "talend", "matillion", "alteryx", "sap", "collibra",
    "alation", "atlan", "hightouch", "census", "airbyte", "excel", "datadog", "hex",
    "streamlit", "mode", "preset", "superset",
)

# --- billing ------------------------------------------------------------------------
CHARGEBACK_TAGS = (
    "cost", "team", "project", "owner", "business", "dept", "department", "bu",
    "chargeback", "env",
)
EGRESS_SKUS = ("internet", "egress")

# --- compute -------------------------------------------------------------------------
CURRENT_INSTANCE_FAMILIES = (
    "d3", "d4", "e4", "d5", "e5", "m5", "m6", "r5", "r6", "c5", "c6", "i3en", "i4", "n2",
    "e2", "c3", "m7", "r7", "c7",
)
ON_DEMAND_ONLY = 999

# --- limits --------------------------------------------------------------------------
HALF = 0.50
LOW_BAR = 0.30
NOT_NULL_PERCENT = 20
IO_CACHE_PERCENT = 50
HEALTHY_FILE_BYTES = 16_777_216
SMALL_TABLE_BYTES = 1_073_741_824
COLD_START_MS = 10_000
MANY_TASKS = 20
CURRENT_RUNTIME_MAJOR = 14
LONG_IDLE_MINUTES = 120
CPU_BAND = (20, 85)
SWAP_PERCENT, IO_WAIT_PERCENT, MEMORY_PERCENT, IDLE_CPU_PERCENT = 1, 20, 90, 20
NODE_WINDOW_DAYS, NODE_EVENTS_DAYS, CLONE_WINDOW_DAYS, TREND_DAYS = 30, 7, 30, 30

# --- sources that a full run should be able to read ------------------------------------
REQUIRED_SOURCES = (
    ("information_schema.tables", "table catalog, most areas"),
    ("information_schema.columns", "column catalog and descriptions"),
    ("access.audit", "audit events"),
    ("access.table_lineage", "lineage events"),
    ("billing.usage", "consumption and serverless share"),
    ("compute.clusters", "cluster configuration"),
    ("compute.warehouses", "warehouse configuration"),
    ("query.history", "query performance and monitoring"),
    ("lakeflow.jobs", "job configuration"),
    ("lakeflow.pipelines", "pipeline configuration"),
    ("storage.table_metrics_history", "file sizes and automatic upkeep"),
    ("mlflow.runs_latest", "experiment tracking"),
    ("serving.served_entities", "model serving"),
)
CORE_TELEMETRY = (
    ("access.audit", "audit events"),
    ("billing.usage", "billing"),
    ("query.history", "queries"),
    ("lakeflow.job_run_timeline", "job runs"),
    ("compute.node_timeline", "node metrics"),
)
