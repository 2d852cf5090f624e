import csv
import glob
import tempfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from posture.plans import reports
from posture.sources import results
from posture.sources.registry import Sources
from posture.sources.schemas import SCHEMAS

STAMP = datetime(2024, 1, 31, tzinfo=UTC)


def rows(run_id, entries):
    return [
        (run_id, STAMP, pillar, q, "p", "t", status, reason, "{}")
        for pillar, q, status, reason in entries
    ]


SAMPLE = [
    ("A", "A-1", "completed", "fine"),
    ("A", "A-2", "open", 'has a | pipe, a comma and "quotes"'),
    ("B", "B-1", "in-progress", "partly"),
    ("B", "B-2", "manual-review", "ask"),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(rows("r1", SAMPLE), results.RESULT_SCHEMA)


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="run-") + "/results"


def stored(spark, path):
    return sorted(
        (r["run_id"], r["question_id"], r["status"])
        for r in results.read_results(spark, path).collect()
    )


def test_replace_by_run_and_area(spark, table, path):
    results.write_results(table, path)
    first = stored(spark, path)
    results.write_results(table, path)
    assert stored(spark, path) == first
    # A new grade of one area replaces that area only.
    again = spark.createDataFrame(
        rows("r1", [("A", "A-1", "open", "worse")]), results.RESULT_SCHEMA
    )
    results.write_results(again, path)
    assert stored(spark, path) == [
        ("r1", "A-1", "open"), ("r1", "B-1", "in-progress"), ("r1", "B-2", "manual-review"),
    ]
    other = spark.createDataFrame(rows("r2", SAMPLE), results.RESULT_SCHEMA)
    results.write_results(other, path)
    assert len(stored(spark, path)) == 7
    results.write_results(other.limit(0), path)
    assert len(stored(spark, path)) == 7
    one = results.run_results(results.read_results(spark, path), "r2")
    assert [r["question_id"] for r in one.collect()] == ["A-1", "A-2", "B-1", "B-2"]
    assert one.columns == list(results.COLUMNS)


def test_a_broken_write_changes_nothing(spark, table, path, monkeypatch):
    """One that fails in its second area, and one that ends before it is noted."""
    results.write_results(table, path)
    first = stored(spark, path)
    status = F.when(F.col("pillar") == "B", F.raise_error(F.lit("lost"))).otherwise(F.lit("open"))
    with pytest.raises(Exception, match="lost"):
        results.write_results(table.withColumn("status", status.cast("string")), path)
    assert stored(spark, path) == first
    worse = table.withColumn("status", F.lit("open"))

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(results, "_note", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            results.write_results(worse, path)
    assert stored(spark, path) == first
    results.write_results(worse, path)
    assert {s for *_, s in stored(spark, path)} == {"open"} and len(stored(spark, path)) == 4


def test_catalog_table(spark, table):
    name = "posture_test.results_" + tempfile.mkdtemp(prefix="run-")[-6:].lower()
    results.write_results_table(table, name)
    results.write_results_table(table, name)
    assert spark.table(name).count() == 4
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    spark.sql(f"DROP TABLE {name}")


def test_stored_or_fresh(spark, table, path):
    fresh = results.stored_or(spark, path, "r1", table)
    assert fresh.count() == 4
    results.write_results(table.where("pillar = 'A'"), path)
    assert results.stored_or(spark, path, "r1", table).count() == 2
    assert results.stored_or(spark, path, "other", table).count() == 4


def test_csv(spark, table, path):
    results.write_csv(table.orderBy("question_id"), path)
    (part,) = glob.glob(f"{path}/*.csv")
    with open(part, newline="") as file:
        lines = list(csv.reader(file))
    assert len(lines) == 5
    assert lines[0] == list(results.EXPORTED)
    assert lines[2][-1] == SAMPLE[1][3]


def collected(frame):
    return [tuple(r) for r in frame.collect()]


def test_summary_reports(table):
    assert collected(reports.status_summary(table)) == [
        ("completed", 1), ("in-progress", 1), ("open", 1), ("manual-review", 1),
    ]
    assert {r[2] for r in collected(reports.status_share(table))} == {25.0}
    # Manual questions do not count for the score.
    assert collected(reports.maturity(table)) == [(1, 3, 33.3)]
    assert collected(reports.by_pillar(table)) == [
        ("A", 2, 1, 0, 1, 0, 50.0), ("B", 2, 0, 1, 0, 1, 0.0),
    ]
    only_manual = table.where("status = 'manual-review'")
    assert collected(reports.maturity(only_manual)) == [(0, 0, None)]
    assert collected(reports.status_summary(only_manual))[0] == ("completed", 0)


def test_listing_reports(table):
    assert [r["question_id"] for r in reports.priority_findings(table).collect()] == [
        "A-2", "B-1",
    ]
    assert [r["question_id"] for r in reports.manual_checklist(table).collect()] == ["B-2"]
    assert [r["question_id"] for r in reports.open_questions(table).collect()] == ["A-2"]
    ranked = table.withColumn("ordinal", F.substring("question_id", 3, 1).cast("int"))
    assert [r["question_id"] for r in reports.top_findings(ranked, "B", 1).collect()] == ["B-1"]
    later = table.withColumn("run_timestamp", F.col("run_timestamp") + F.expr("INTERVAL 1 DAY"))
    past = reports.history(table.unionByName(later.withColumn("run_id", F.lit("r2"))), "A-1")
    assert [r["run_id"] for r in past.collect()] == ["r2", "r1"]


def test_registry(spark):
    known = spark.createDataFrame([], SCHEMAS["query.history"])
    sources = Sources(spark, {"query.history": known, "access.audit": "no_such.table"})
    assert sources.readable("query.history")
    assert not sources.readable("access.audit")
    assert sources.has_column("query.history", "executed_by")
    assert not sources.has_column("query.history", "nothing")
    first = sources.first_unreadable(["query.history", "billing.usage", "access.audit"])
    assert collected(first) == [("billing.usage",)]
    assert collected(sources.first_unreadable(["query.history"])) == []
    ready = {r["source"]: r["readable"] for r in sources.readiness().collect()}
    assert len(ready) == 13
    assert [s for s, ok in ready.items() if ok] == ["query.history"]
    assert sources.availability().count() == len(SCHEMAS)
    census = {r["source"]: (r["readable"], r["n"]) for r in sources.census().collect()}
    assert len(census) == len(SCHEMAS)
    assert census["query.history"] == (True, 0) and census["access.audit"] == (False, None)
    assert "access.audit" in sources.problems


def test_directory_source(spark):
    root = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame([("a",)], "workspace_id string").write.parquet(
        f"{root}/access/workspaces_latest"
    )
    sources = Sources.from_directory(spark, root, probe_rows=True)
    assert sources.frame("access.workspaces_latest").count() == 1
    assert not sources.readable("billing.usage")
    with pytest.raises(LookupError, match="not readable"):
        sources.frame("billing.usage")
