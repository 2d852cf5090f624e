"""SQL for the scorecard and the report tables."""

from __future__ import annotations

import re
from datetime import date, timedelta

from oracle.questions import BODIES, question_sql, shown
from oracle.views import FIVE, VIEWS, with_views
from posture.sources.star_telemetry import FLAT, flat_sql

MANUAL_IDS = ("DG-01-01", "DG-03-01", "OE-01-01", "OE-01-09", "OE-03-03", "PE-03-01")
PILLAR = (
    "CASE split_part(question_id, '-', 1) WHEN 'DG' THEN 'Data & AI Governance'"
    " WHEN 'IU' THEN 'Interoperability & Usability' WHEN 'OE' THEN 'Operational Excellence'"
    " WHEN 'R' THEN 'Reliability' WHEN 'PE' THEN 'Performance Efficiency'"
    " ELSE 'Cost Optimization' END"
)
_GRADED = " UNION ALL ".join(
    f"SELECT question_id, status FROM ({body})" for body in BODIES.values()
)
_MANUAL = " UNION ALL ".join(
    f"SELECT '{q}' AS question_id, 'manual-review' AS status" for q in MANUAL_IDS
)
VIEWS["x_card"] = (
    f"SELECT question_id, status, {PILLAR} AS pillar FROM ({_GRADED} UNION ALL {_MANUAL})"
)
SCORE = (
    "round(count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE /"
    " nullif(count(*) FILTER (WHERE status <> 'manual-review'), 0), 1)"
)
STATUSES = "(VALUES ('completed'), ('in-progress'), ('open'), ('manual-review')) AS s(status)"
_SUMMARY = (
    "SELECT s.status, count(c.question_id) AS n"
    f" FROM {STATUSES} LEFT JOIN x_card AS c ON c.status = s.status GROUP BY s.status"
)

REPORTS = {
    "scorecard": "SELECT question_id, pillar, status FROM x_card",
    "report_status_summary": _SUMMARY,
    "report_status_share": (
        "SELECT status, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS share_pct"
        f" FROM ({_SUMMARY})"
    ),
    "report_maturity": (
        "SELECT count(*) FILTER (WHERE status = 'completed') AS completed,"
        " count(*) FILTER (WHERE status <> 'manual-review') AS scored,"
        f" {SCORE} AS score_pct FROM x_card"
    ),
    "report_by_pillar": (
        "SELECT pillar, count(*) AS questions,"
        " count(*) FILTER (WHERE status = 'completed') AS completed,"
        " count(*) FILTER (WHERE status = 'in-progress') AS in_progress,"
        " count(*) FILTER (WHERE status = 'open') AS open,"
        " count(*) FILTER (WHERE status = 'manual-review') AS manual_review,"
        f" {SCORE} AS score_pct FROM x_card GROUP BY pillar"
    ),
    "report_by_pillar_and_status": (
        "SELECT pillar, status, count(*) AS n FROM x_card GROUP BY pillar, status"
    ),
    "report_priority_findings": (
        "SELECT question_id, pillar, status FROM x_card"
        " WHERE status IN ('open', 'in-progress')"
    ),
    "report_detail": "SELECT question_id, pillar, status FROM x_card",
    "report_manual_checklist": (
        "SELECT question_id, pillar FROM x_card WHERE status = 'manual-review'"
    ),
    "report_open_questions": "SELECT question_id, pillar FROM x_card WHERE status = 'open'",
    "report_top_findings": (
        "SELECT question_id, status FROM x_card WHERE pillar = 'Reliability' ORDER BY"
        " CASE status WHEN 'open' THEN 0 WHEN 'in-progress' THEN 1"
        " WHEN 'manual-review' THEN 2 ELSE 3 END, question_id LIMIT 10"
    ),
}


def report_sql(name: str) -> str:
    return with_views(REPORTS[name])


# A set of sources in which the audit log is absent, the pipelines have no rows, and the share
# of user time in the node samples cannot be read.
NEED_AUDIT = ("DG-02-02", "DG-02-03", "R-02-03")
NEED_CPU = ("CO-01-08", "PE-02-07")
_LOST = ", ".join(f"'{q}'" for q in (*NEED_AUDIT, *NEED_CPU))
DEGRADED = {
    "x_audit": f"SELECT * FROM ({VIEWS['x_audit']}) WHERE FALSE",
    "x_pipelines": f"SELECT * FROM ({VIEWS['x_pipelines']}) WHERE FALSE",
    "x_card": (
        "SELECT question_id, pillar, CASE WHEN question_id IN"
        f" ({_LOST}) THEN 'open' ELSE status END AS status FROM ({VIEWS['x_card']})"
    ),
}


def degraded_sql(name: str) -> str:
    return with_views(REPORTS[name], DEGRADED)


def census_sql() -> str:
    """Rows of every source of that set."""
    absent, empty = "access.audit", "lakeflow.pipelines"
    return " UNION ALL ".join(
        f"SELECT '{source}' AS source, FALSE AS readable, CAST(NULL AS BIGINT) AS n"
        if source == absent
        else f"SELECT '{source}' AS source, TRUE AS readable, count(*) AS n FROM"
        f" ({flat_sql(source, FIVE)}) WHERE {'FALSE' if source == empty else 'TRUE'}"
        for source in FLAT
    )


# Numbers of a question's metrics, and the share that follows from two of them.
_FIELDS = " UNION ALL ".join(
    f"SELECT question_id, status, to_json(m) AS j FROM ({shown(q)}) AS m" for q in BODIES
)
_NUMBER = "TRY_CAST(json_extract_string(j, '$.' || field) AS DOUBLE)"
FIELDS_SQL = with_views(
    f"SELECT question_id, field, CASE json_extract_string(j, '$.' || field) WHEN 'true' THEN 1.0"
    f" WHEN 'false' THEN 0.0 ELSE {_NUMBER} END AS value FROM (SELECT question_id, j,"
    f" unnest(json_keys(j)) AS field FROM ({_FIELDS})) WHERE field NOT IN ('question_id',"
    " 'status')"
    " UNION ALL SELECT question_id, 'pct' AS field, CASE WHEN status <> 'open' THEN"
    " round(CAST(j->>'numerator' AS DOUBLE) * 100 / CAST(j->>'denominator' AS DOUBLE), 2) END"
    f" AS value FROM ({_FIELDS}) WHERE j->>'numerator' IS NOT NULL AND j->>'denominator'"
    " IS NOT NULL"
)


def earlier(sql: str, days: int) -> str:
    """The same statement ``days`` before AS_OF: all of its dates move."""

    def moved(found: re.Match) -> str:
        return (date.fromisoformat(found[0]) - timedelta(days)).isoformat()

    bounds = "2024-01-31|2024-01-24|2024-01-01|2023-12-02|2023-11-02"
    return re.sub(bounds, moved, sql)


def history_sql(question_id: str, days: int) -> str:
    """A question at AS_OF and some days before."""
    now = question_sql(question_id)
    before = earlier(now, days)
    return (
        f"SELECT 'now' AS run_id, status, numerator, denominator FROM ({now}) UNION ALL"
        f" SELECT 'before' AS run_id, status, numerator, denominator FROM ({before})"
    )


OPERATORS = {
    "scope": with_views(
        "SELECT catalog_name, 'prod' AS mode FROM x_scope"
    ),
    "scope_fallback": with_views(
        "SELECT catalog_name, 'all' AS mode FROM x_own_catalogs"
    ),
    "scoped_tables": with_views(
        "SELECT table_catalog, table_schema, count(*) AS n FROM x_tables WHERE"
        " table_catalog IN (SELECT catalog_name FROM x_scope) AND NOT (lower(table_schema)"
        " LIKE '%dev%' OR lower(table_schema) LIKE '%test%' OR lower(table_schema) LIKE"
        " '%sandbox%' OR lower(table_schema) LIKE '%tmp%' OR lower(table_schema) LIKE"
        " '%scratch%') AND lower(table_schema) <> 'information_schema' GROUP BY ALL"
    ),
    "latest_jobs": with_views("SELECT job_id, version FROM x_latest_jobs"),
    "latest_jobs_rank_first": with_views(
        "SELECT job_id, version FROM (SELECT * FROM x_jobs QUALIFY row_number() OVER"
        " (PARTITION BY job_id ORDER BY change_time DESC, version DESC) = 1)"
        " WHERE delete_time IS NULL"
    ),
    "latest_jobs_past": earlier(with_views("SELECT job_id, version FROM x_latest_jobs"), 31),
    "latest_jobs_tied": with_views(
        "SELECT job_id, max(date_trunc('year', change_time)) AS change_time FROM x_jobs"
        " WHERE delete_time IS NULL GROUP BY job_id"
    ),
    "latest_table_snapshots": with_views("SELECT table_id, version FROM x_latest_storage"),
    "inventory_counts": with_views(
        "SELECT collection AS key, count(*) AS n FROM x_workspace_inventory GROUP BY 1"
    ),
}
