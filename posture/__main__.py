"""Batch entry: ``spark-submit ... -m posture --results <path> [--tables <prefix>]``."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from posture.assess import assess
from posture.config import AssessmentConfig
from posture.plans import reports
from posture.plans.bank import PILLARS
from posture.sources.registry import Sources
from posture.sources.results import write_csv


def main() -> None:
    parser = argparse.ArgumentParser(prog="posture")
    where = parser.add_mutually_exclusive_group(required=True)
    where.add_argument("--tables", help="prefix of the telemetry tables in the catalog")
    where.add_argument("--directory", help="directory with <schema>/<table> Parquet data")
    parser.add_argument("--results", required=True, help="path of the result table")
    parser.add_argument("--csv", help="path of a CSV export")
    parser.add_argument("--as-of", type=datetime.fromisoformat, help="UTC time to assess at")
    parser.add_argument("--lookback-days", type=int, default=90)
    parser.add_argument("--complete-at", type=float, default=0.80)
    parser.add_argument("--run-id")
    lists = {
        "production_patterns": "LIKE patterns of production catalogs",
        "excluded_schemas": "LIKE patterns of schemas to leave out",
        "system_catalogs": "LIKE patterns of the platform's own catalogs",
        "exclude_principals": "principals whose activity is left out",
        "schema_services": "LIKE patterns of audited services that alter schemas",
        "sql_products": "LIKE patterns of the SQL product in billing",
    }
    for name, meaning in lists.items():
        parser.add_argument(f"--{name.replace('_', '-')}", nargs="*", help=meaning)
    parser.add_argument(
        "--no-probe", action="store_true", help="do not read a row of each source first"
    )
    parser.add_argument("--areas", nargs="*", choices=list(PILLARS))
    options = parser.parse_args()

    given = {"as_of": options.as_of} if options.as_of else {}
    given |= {n: tuple(v) for n in lists if (v := getattr(options, n)) is not None}
    config = AssessmentConfig(
        lookback_days=options.lookback_days,
        complete_at=options.complete_at,
        run_id=options.run_id,
        **given,
    )
    spark = SparkSession.builder.appName("posture").getOrCreate()
    if options.directory:
        sources = Sources.from_directory(
            spark, options.directory, probe_rows=not options.no_probe
        )
    else:
        sources = Sources.from_tables(spark, options.tables, probe_rows=not options.no_probe)
    sources.readiness().show(truncate=False)
    rows = assess(sources, config, options.results, options.areas or None)
    if options.csv:
        write_csv(rows, options.csv)
    reports.status_share(rows).show(truncate=False)
    reports.maturity(rows).show(truncate=False)
    reports.by_pillar(rows).show(truncate=False)
    reports.priority_findings(rows).select("question_id", "status", "question").show(
        200, truncate=False
    )
    spark.stop()


if __name__ == "__main__":
    main()
