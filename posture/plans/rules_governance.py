"""Rules: data and AI governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from posture.fixed_values import COMPLETED, IN_PROGRESS, OPEN
from posture.functions.grading import (
    downgrade,
    listing,
    percent,
    percent_text,
    sentence,
    whole,
)
from posture.plans.rules import Evidence, Verdict, manual, question

TABLES = "information_schema.tables"

manual(
    "DG-01-01",
    "a governance process is an agreement between people.",
    "the governance charter, the named owners and how often policies are reviewed.",
)


@question("DG-01-02", TABLES, scoped=True)
def described_tables(e: Evidence) -> Verdict:
    total, owned = e.n("tables.base"), e.n("tables.owned")
    return e.ratio(
        e.n("tables.documented"),
        total,
        f"tables in {e.where} have a description",
        extra=sentence("An owner is set on {}.", percent_text(percent(owned, total) / 100)),
        metrics={"owned": owned},
    )


@question("DG-01-03", TABLES, scoped=True)
def governed_tables(e: Evidence) -> Verdict:
    governed, legacy = e.n("tables.base"), e.n("tables.legacy_base")
    queries, principals = e.n("queries.lineage"), e.n("queries.lineage_principals")
    views, tables = e.n("views.on_lineage"), e.n("lineage.derived_tables")
    return e.ratio(
        governed,
        governed + legacy,
        f"tables in {e.where} or the legacy metastore are governed and so traced",
        extra=sentence(
            "{} table(s) are left in the legacy metastore. Lineage is used by {} view(s),"
            " {} derived table(s) and {} query/queries of {} principal(s) in {} days.",
            whole(legacy), whole(views), whole(tables), whole(queries), whole(principals),
            e.days,
        ),
        metrics={
            "hive_metastore_tables": legacy,
            "uc_tables": governed,
            "lineage_queries": queries,
            "lineage_query_principals": principals,
            "lineage_derived_views": views,
            "lineage_derived_tables": tables,
        },
    )


@question("DG-01-04", "information_schema.columns", scoped=True)
def described_columns(e: Evidence) -> Verdict:
    return e.ratio(
        e.n("columns.documented"),
        e.n("columns.total"),
        f"columns in {e.where} have a description",
    )


@question("DG-01-05", TABLES, scoped=True)
def tagged_tables(e: Evidence) -> Verdict:
    total, keys = e.n("tables.base"), e.n("tags.keys")
    tagged = e.n("tags.tagged")
    return e.ratio(
        F.when(total == 0, tagged).otherwise(F.least(tagged, total)),
        total,
        f"tables in {e.where} have a tag to be found by",
        extra=sentence("{} tag key(s) are in use.", whole(keys)),
        metrics={"distinct_tag_names": keys, "tagged_tables": tagged},
    )


@question("DG-01-06", "information_schema.routines", scoped=True)
def governed_models(e: Evidence) -> Verdict:
    models = F.coalesce(e.inventory("registered_models"), F.lit(0))
    functions, experiments = e.n("routines.total"), e.n("experiments.live")
    status = (
        F.when(models > 0, COMPLETED).when(functions > 0, IN_PROGRESS).otherwise(OPEN)
    )
    return Verdict(
        status,
        sentence(
            "{} model(s) and {} function(s) are registered next to the data; {} experiment(s)"
            " are tracked.",
            whole(models), whole(functions), whole(experiments),
        ),
        {"uc_models": models, "uc_functions": functions, "experiments": experiments},
    )


@question("DG-02-01", "information_schema.table_privileges", scoped=True)
def central_grants(e: Evidence) -> Verdict:
    total, personal = e.n("grants.total"), e.n("grants.personal")
    legacy = e.n("lineage.legacy_events")
    verdict = e.ratio(
        total - personal,
        total,
        "table grants in scope go to groups or service principals",
        nothing="No table grants in scope, so there is no sign of central access control.",
        metrics={"user_grants": personal, "hive_lineage_events": legacy},
    )
    lowered = (verdict.status == COMPLETED) & (legacy > 0)
    return Verdict(
        downgrade(verdict.status, legacy > 0),
        F.concat(
            verdict.reason,
            sentence(
                " {} lineage event(s) still touch the legacy metastore in {} days.{}",
                whole(legacy),
                e.days,
                F.when(lowered, " Held at in-progress: two metastores are in use.").otherwise(""),
            ),
        ),
        verdict.metrics,
    )


@question("DG-02-02", "access.audit")
def audit_coverage(e: Evidence) -> Verdict:
    events, days = e.n("audit.events"), e.n("audit.days")
    verdict = e.ratio(
        F.when(events > 0, days),
        F.lit(e.config.lookback_days).cast("long"),
        "days of the window have audit events",
        nothing=f"The audit log is readable but empty for {e.config.lookback_days} days.",
        extra=sentence(
            "{} event(s), the newest on {}.",
            whole(events),
            F.coalesce(
                F.date_from_unix_date(e.value("audit.last_day").cast("int")).cast("string"),
                F.lit("no day"),
            ),
        ),
        metrics={"events": events},
    )
    return verdict


@question("DG-02-03", "access.audit")
def audit_review(e: Evidence) -> Verdict:
    queries, people = e.n("queries.audit"), e.n("queries.audit_principals")
    actions = e.n("audit.actions")
    return Verdict(
        F.when(queries == 0, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} query/queries of {} principal(s) read the audit log in {} days; it holds {}"
            " kind(s) of action.",
            whole(queries), whole(people), e.days, whole(actions),
        ),
        {"unique_actions": actions, "audit_queries": queries, "audit_consumers": people},
    )


manual(
    "DG-03-01",
    "quality standards and their limits are written down outside the platform.",
    "the quality standard, the team that owns it and how breaches are escalated.",
)


@question("DG-03-02", TABLES, "information_schema.table_constraints", scoped=True)
def quality_controls(e: Evidence) -> Verdict:
    total = e.n("tables.base")
    monitored, constrained = e.n("monitored.tables"), e.n("constraints.tables")
    pipelines = e.n("pipelines.versions")
    silent = (monitored == 0) & (constrained == 0) & (pipelines == 0)
    verdict = e.ratio(
        F.when(total == 0, F.lit(0)).otherwise(F.least(monitored + constrained, total)),
        total,
        f"tables in {e.where} have a monitor or a constraint",
        metrics={
            "monitored": monitored,
            "constrained": constrained,
            "declarative_pipelines": pipelines,
        },
    )
    return Verdict(
        F.when(silent, OPEN).otherwise(verdict.status),
        F.when(
            silent, "No monitors, constraints or declarative pipelines: no quality tooling."
        ).otherwise(
            F.concat(
                verdict.reason,
                sentence(
                    " Signals: {} monitored and {} constrained table(s), {} declarative"
                    " pipeline(s).",
                    whole(monitored), whole(constrained), whole(pipelines),
                ),
            )
        ),
        verdict.metrics,
    )


@question("DG-03-03", TABLES, scoped=True)
def standard_format(e: Evidence) -> Verdict:
    mix = e.mix("tables.formats")
    return e.ratio(
        e.n("tables.transactional"),
        e.n("tables.base"),
        f"tables in {e.where} use the standard format",
        extra=sentence("Formats: {}.", listing(mix)),
        metrics={"format_mix": F.map_from_entries(mix)},
    )
