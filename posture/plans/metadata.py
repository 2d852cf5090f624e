"""Evidence from the metadata catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.functions.text import any_like, has_any, lowered, non_blank
from posture.operators.evidence import Distinct, Groups, GroupTest, Pass, Rows, Top
from posture.operators.run import Run
from posture.operators.scope import IN_SCOPE
from posture.plans.passes import evidence

TABLES = "information_schema.tables"
TRIPLE = ("table_catalog", "table_schema", "table_name")
TAG_TRIPLE = ("catalog_name", "schema_name", "table_name")


def _format():
    return lowered(F.col("data_source_format"))


def _base():
    return F.col("table_type") != "VIEW"


@evidence("tables", TABLES, scoped=True)
def tables(run: Run) -> Pass:
    frame = run.scope.mark(run.sources.frame(TABLES), "table_catalog", "table_schema")
    inside = F.col(IN_SCOPE)
    base = inside & _base()
    documented = non_blank(F.col("comment"))
    owned = non_blank(F.col("table_owner"))
    legacy = F.lower(F.col("table_catalog")) == fixed.LEGACY_CATALOG
    name, kind = F.lower(F.col("table_name")), lowered(F.col("table_type"))
    schema = F.lower(F.col("table_schema"))
    metrics = {
        "base": Rows(base),
        "documented": Rows(base & documented),
        "owned": Rows(base & owned),
        "product_ready": Rows(base & documented & owned),
        "legacy_base": Rows(legacy & _base()),
        "legacy": Rows(legacy),
        "transactional": Rows(base & _format().isin(*fixed.TRANSACTIONAL_FORMATS)),
        "delta": Rows(base & (_format() == "delta")),
        "open_format": Rows(base & _format().isin(*fixed.OPEN_FORMATS)),
        "open_table_format": Rows(base & _format().isin(*fixed.OPEN_TABLE_FORMATS)),
        "views": Rows(inside & (F.col("table_type") == "VIEW")),
        "metric_views": Rows(inside & kind.contains("metric")),
        "streaming": Rows(inside & kind.contains("streaming")),
        "quarantine": Rows(inside & any_like(F.col("table_name"), fixed.QUARANTINE_NAMES)),
        "duplicates": Rows(base & name.rlike(fixed.DUPLICATE_NAME)),
        "schemas": Distinct("table_schema", inside),
        "formats": Top("format", 5, base),
        "closed_formats": Top("format", 5, base & ~_format().isin(*fixed.OPEN_FORMATS)),
        "unsafe_formats": Top(
            "format", 5, base & ~_format().isin(*fixed.TRANSACTIONAL_FORMATS)
        ),
    }
    for layer, (words, prefix) in fixed.LAYERS.items():
        metrics[layer] = Distinct(
            "table_schema", inside & (has_any(schema, words) | name.rlike(prefix))
        )
    return Pass(
        frame,
        {f"tables.{n}": m for n, m in metrics.items()},
        carrier=("table_schema",),
        keys={"format": F.coalesce(F.col("data_source_format"), F.lit("UNKNOWN"))},
    )


@evidence("columns", "information_schema.columns", scoped=True)
def columns(run: Run) -> Pass:
    frame = run.scope.restrict(
        run.sources.frame("information_schema.columns"), "table_catalog", "table_schema"
    )
    name = F.lower(F.col("column_name"))
    partition_key = F.col("partition_index").isNotNull()
    return Pass(
        frame,
        {
            "columns.total": Rows(),
            "columns.documented": Rows(non_blank(F.col("comment"))),
            "columns.not_null": Rows(F.col("is_nullable") == "NO"),
            "columns.rescued": Groups(name == fixed.RESCUE_COLUMNS[0]),
            "columns.rescued_any": Groups(name.isin(*fixed.RESCUE_COLUMNS)),
            "columns.tables": GroupTest(None, lambda n: n > 0),
            "columns.unpartitioned": GroupTest(partition_key, lambda n: n == 0),
            "columns.lightly_partitioned": GroupTest(partition_key, lambda n: n.between(1, 2)),
            "columns.heavily_partitioned": GroupTest(partition_key, lambda n: n > 2),
        },
        carrier=TRIPLE,
    )


@evidence("views", "information_schema.views")
def views(run: Run) -> Pass:
    text = F.lower(F.col("view_definition"))
    return Pass(
        run.sources.frame("information_schema.views"),
        {"views.on_lineage": Rows(text.like(fixed.LINEAGE_TEXT))},
    )


@evidence(
    "tags", "information_schema.table_tags", scoped=True, unscoped=("tags.features",)
)
def tags(run: Run) -> Pass:
    frame = run.marked(
        run.sources.frame("information_schema.table_tags"), "catalog_name", "schema_name"
    )
    inside = F.col(IN_SCOPE)
    product = has_any(F.lower(F.col("tag_name")), fixed.PRODUCT_TAG_NAMES) | has_any(
        F.lower(F.col("tag_value")), fixed.PRODUCT_TAG_VALUES
    )
    return Pass(
        frame,
        {
            "tags.tagged": Groups(inside),
            "tags.keys": Distinct("tag", inside),
            "tags.certified": Groups(inside & product),
            "tags.features": Groups(F.lower(F.col("tag_name")).contains("feature")),
        },
        carrier=TAG_TRIPLE,
        spread={"tag": F.col("tag_name")},
    )


@evidence("constraints", "information_schema.table_constraints", scoped=True)
def constraints(run: Run) -> Pass:
    frame = run.scope.restrict(
        run.sources.frame("information_schema.table_constraints"),
        "table_catalog",
        "table_schema",
    )
    return Pass(
        frame,
        {"constraints.tables": Groups(), "constraints.kinds": Top("kind", None)},
        carrier=TRIPLE,
        keys={"kind": F.col("constraint_type")},
    )


@evidence("grants", "information_schema.table_privileges", scoped=True)
def grants(run: Run) -> Pass:
    frame = run.scope.restrict(
        run.sources.frame("information_schema.table_privileges"),
        "table_catalog",
        "table_schema",
    )
    return Pass(
        frame,
        {"grants.total": Rows(), "grants.personal": Rows(F.col("grantee").ilike("%@%"))},
    )


@evidence("schema_grants", "information_schema.schema_privileges")
def schema_grants(run: Run) -> Pass:
    readers = F.lower(F.col("privilege_type")).isin(*fixed.READ_PRIVILEGES)
    return Pass(
        run.sources.frame("information_schema.schema_privileges"),
        {"schema_grants.readers": Distinct("grantee", readers)},
        carrier=("grantee",),
    )


@evidence("routines", "information_schema.routines", scoped=True)
def routines(run: Run) -> Pass:
    frame = run.scope.restrict(
        run.sources.frame("information_schema.routines"), "routine_catalog", "routine_schema"
    )
    foreign = lowered(F.col("external_language")).isin(*fixed.NATIVE_LANGUAGES_EXCLUDED)
    return Pass(
        frame,
        {
            "routines.total": Rows(),
            "routines.foreign": Rows(foreign),
            "routines.sql": Rows(~foreign),
        },
    )


@evidence("catalogs", "information_schema.catalogs", scoped=True)
def catalogs(run: Run) -> Pass:
    frame = run.scope.mark(run.sources.frame("information_schema.catalogs"), "catalog_name")
    own = any_like(F.col("catalog_name"), run.config.system_catalogs, negate=True)
    name = F.lower(F.col("catalog_name"))
    metrics = {
        "catalogs.total": Rows(own),
        "catalogs.documented": Rows(own & non_blank(F.col("comment"))),
        "catalogs.owned": Rows(own & non_blank(F.col("catalog_owner"))),
    }
    for tier, words in fixed.ENVIRONMENT_TIERS.items():
        metrics[f"catalogs.{tier}"] = Rows(own & has_any(name, words))
    if run.sources.has_column("information_schema.catalogs", "custom_max_retention_hours"):
        kept = F.col("custom_max_retention_hours").isNotNull()
        metrics["catalogs.with_retention"] = Rows(F.col(IN_SCOPE) & kept)
    else:
        metrics["catalogs.with_retention"] = Rows(F.lit(False))
    return Pass(frame, metrics)


def _row_counts(name: str, source: str):
    @evidence(name, source)
    def count_rows(run: Run) -> Pass:
        return Pass(run.sources.frame(source), {f"{name}.rows": Rows()})

    return count_rows


for _name in ("connections", "external_locations", "storage_credentials", "shares"):
    _row_counts(_name, f"information_schema.{_name}")
_row_counts("shared_tables", "information_schema.table_share_usage")
_row_counts("streams", "lakeflow.zerobus_stream")
_row_counts("replication", "replication.states")
_row_counts("materializations", "sharing.materialization_history")


@evidence("ip_ranges", "information_schema.recipient_allowed_ip_ranges")
def ip_ranges(run: Run) -> Pass:
    return Pass(
        run.sources.frame("information_schema.recipient_allowed_ip_ranges"),
        {"ip_ranges.recipients": Distinct("recipient_name")},
        carrier=("recipient_name",),
    )


@evidence("workspaces", "access.workspaces_latest")
def workspaces(run: Run) -> Pass:
    return Pass(
        run.sources.frame("access.workspaces_latest"),
        {"workspaces.total": Distinct("workspace_id")},
        carrier=("workspace_id",),
    )


@evidence("monitored", "data_quality_monitoring.table_results", scoped=True)
def monitored(run: Run) -> Pass:
    frame = run.scope.restrict(
        run.sources.frame("data_quality_monitoring.table_results"),
        "catalog_name",
        "schema_name",
    )
    return Pass(frame, {"monitored.tables": Groups()}, carrier=TAG_TRIPLE)


INVENTORY = ("registered_models", "recipients", "cluster_policies", "repos", "git_credentials")


@evidence("inventory", "workspace_inventory")
def inventory(run: Run) -> Pass:
    """Items per collection, and whether the collection was taken at all.

    A row without an item says that the collection was taken and is empty.
    """
    counts = {}
    for c in INVENTORY:
        mine = F.col("collection") == c
        counts[f"inventory.{c}"] = Rows(mine & F.col("item_id").isNotNull())
        counts[f"inventory.{c}_taken"] = Rows(mine)
    return Pass(run.sources.frame("workspace_inventory"), counts)
