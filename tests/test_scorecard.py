import json
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from posture.assess import assess, questions_of
from posture.config import AssessmentConfig
from posture.operators.evidence import MIX, Mean, _Grouped, columns_read, measure
from posture.operators.run import Run
from posture.plans.bank import PILLARS, questions
from posture.plans.passes import PASSES
from posture.plans.reports import coverage_gaps, unmeasured
from posture.plans.rules import RULES, decide, depends
from posture.plans.scorecard import (
    RETRIES,
    Measurement,
    answer,
    check_coverage,
    question_ids,
    scorecard,
)
from posture.sources.registry import Sources
from posture.sources.schemas import SCHEMAS
from posture.sources.star_telemetry import AS_OF, FLAT, star_sources, star_table
from conftest import SF_DIR

MANUAL_IDS = ["DG-01-01", "DG-03-01", "OE-01-01", "OE-01-09", "OE-03-03", "PE-03-01"]
# Nothing found is the good outcome, if the source was readable.
GOOD_WHEN_EMPTY = {
    "PE-02-04", "CO-01-04", "CO-01-07", "CO-03-05", "CO-04-02", "OE-04-01",
}


@pytest.fixture(scope="module")
def card(star_run):
    return {r["question_id"]: r for r in scorecard(star_run).collect()}


def graded(sources, **options):
    run = Run(sources, AssessmentConfig(as_of=AS_OF, **options))
    return {r["question_id"]: r for r in scorecard(run).collect()}


def test_bank():
    assert len(questions()) == 151
    per_area = Counter(q.pillar_id for q in questions())
    assert [per_area[p] for p in PILLARS] == [12, 14, 26, 38, 19, 23, 19]


def test_coverage(spark):
    assert len(question_ids()) == 113
    check_coverage()
    assert coverage_gaps(spark, RULES).count() == 0
    fewer = [q for q in RULES if q != "R-01-01"] + ["ZZ-1"]
    gaps = {tuple(r) for r in coverage_gaps(spark, fewer).collect()}
    assert gaps == {("R-01-01", "no rule"), ("ZZ-1", "not in the bank")}
    with pytest.raises(AssertionError, match="R-01-01"):
        check_coverage(fewer)
    assert [tuple(r) for r in unmeasured(spark).collect()] == [
        ("Security, Compliance & Privacy", 38)
    ]


def test_every_source_has_a_schema_and_a_derivation():
    read = {p.source for p in PASSES.values()}
    assert read <= SCHEMAS.keys()
    assert SCHEMAS.keys() == FLAT.keys()


def test_rows_are_complete(card):
    assert len(card) == 113
    for row in card.values():
        assert row["status"] in {"open", "in-progress", "completed", "manual-review"}
        assert len(row["reason"]) > 25, row["question_id"]
        assert row["pillar"] and row["principle"] and row["question"]
        assert isinstance(json.loads(row["metrics_json"]), dict)
    manual = sorted(q for q, r in card.items() if r["status"] == "manual-review")
    assert manual == MANUAL_IDS


@pytest.mark.skipif(not SF_DIR.endswith("sf0.01"), reason="values of one scale")
def test_known_values(card):
    def metrics(question_id):
        return json.loads(card[question_id]["metrics_json"])

    expected = {
        "DG-01-02": {"denominator": 566, "numerator": 340, "owned": 462},
        "IU-04-02": {"views": 103, "tables": 566, "metric_views": 115},
        "R-02-02": {"denominator": 566, "suspect_duplicates": 52},
        "R-02-03": {"total_columns": 3345, "not_null_columns": 993},
        "PE-02-12": {
            "denominator": 669, "unpartitioned": 123, "lightly_partitioned": 282,
            "heavily_partitioned": 264,
        },
        "PE-02-01": {"queries": 7986, "pruned_files": 394772, "read_files": 141399},
        "PE-03-03": {
            "queries": 7986, "spilling": 1139, "shuffle_heavy": 597, "queued": 7569,
        },
        "CO-01-06": {"denominator": 51337, "numerator": 27981},
        "CO-01-02": {"denominator": 44831, "all_purpose_dbus": 14044.0},
        "R-01-04": {"denominator": 1500, "numerator": 753},
        "OE-01-03": {"numerator": 591},
        "CO-01-08": {"clusters": 150, "avg_cpu_pct": 33.96, "avg_mem_pct": 46.91},
    }
    for question_id, values in expected.items():
        got = metrics(question_id)
        assert {k: got[k] for k in values} == values, question_id


def test_single_questions_equal_the_fused_run(star_run, card):
    for question_id in ("PE-03-03", "CO-02-01", "DG-02-01", "OE-03-04"):
        alone = answer(star_run, question_id).first().asDict()
        fused = json.loads(card[question_id]["metrics_json"])
        assert alone.pop("status") == card[question_id]["status"]
        alone.pop("question_id")
        assert alone == {k: fused[k] for k in alone}


def test_nothing_readable(spark):
    rows = graded(Sources(spark, {}))
    statuses = Counter(r["status"] for r in rows.values())
    assert statuses["completed"] == 0
    assert statuses["in-progress"] == 0
    assert statuses["open"] / len(rows) > 0.85
    assert [q for q, r in rows.items() if len(r["reason"]) <= 25] == []


def test_everything_empty(spark):
    rows = graded(Sources.empty(spark))
    completed = {q for q, r in rows.items() if r["status"] == "completed"}
    assert completed == GOOD_WHEN_EMPTY
    assert {q for q, r in rows.items() if r["status"] == "manual-review"} == set(MANUAL_IDS)
    assert [q for q, r in rows.items() if len(r["reason"]) <= 25] == []


@pytest.mark.parametrize("missing", ["query.history", "billing.usage", "access.audit"])
def test_one_missing_source(spark, missing, card):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT if n != missing}
    rows = graded(Sources(spark, kept))
    for question_id, spec in RULES.items():
        if missing in spec.needs:
            assert rows[question_id]["status"] == "open"
            assert missing in rows[question_id]["reason"]
    untouched = [q for q in rows if rows[q]["status"] == card[q]["status"]]
    assert len(untouched) > 60


def test_missing_column_fails_only_its_questions(spark):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT}
    kept["query.history"] = kept["query.history"].drop("spilled_local_bytes")
    rows = graded(Sources(spark, kept))
    for question_id in ("PE-02-15", "PE-03-03"):
        assert rows[question_id]["status"] == "open"
        assert "nothing is claimed" in rows[question_id]["reason"]
        assert json.loads(rows[question_id]["metrics_json"])["error"] is True
    assert rows["PE-02-08"]["status"] == "completed"


def test_optional_column(spark):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT}
    kept["information_schema.catalogs"] = kept["information_schema.catalogs"].drop(
        "custom_max_retention_hours"
    )
    run = Run(Sources(spark, kept), AssessmentConfig(as_of=AS_OF))
    row = answer(run, "R-04-02").first()
    assert row["catalogs_with_retention"] == 0
    assert row["status"] == "in-progress"


def test_failing_scan_is_isolated(spark):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT}
    broken = kept["compute.node_timeline"].withColumn(
        "mem_used_percent", F.raise_error(F.lit("lost file")).cast("double")
    )
    kept["compute.node_timeline"] = broken
    rows = assess(
        Sources(spark, kept, probe_rows=False),
        AssessmentConfig(as_of=AS_OF),
        pillars=["performance-efficiency"],
    )
    got = {r["question_id"]: r for r in rows.collect()}
    assert got["PE-02-07"]["status"] == "open"
    assert "nothing is claimed" in got["PE-02-07"]["reason"]
    assert got["PE-02-08"]["status"] == "completed"


@pytest.mark.parametrize("damage", ["truncated", "missing"])
def test_a_damaged_file_is_isolated(spark, card, tmp_path, damage):
    """Found by the probe, or, if the probe is off, by the pass that reads the file."""
    full = star_sources(spark, SF_DIR)
    path = tmp_path / "runs"
    full.frame("mlflow.runs_latest").coalesce(1).write.parquet(str(path))
    kept = {n: full.frame(n) for n in FLAT}
    kept["mlflow.runs_latest"] = spark.read.parquet(str(path))
    (data,) = path.glob("part-*.parquet")
    if damage == "truncated":
        data.write_bytes(data.read_bytes()[: data.stat().st_size // 2])
    else:
        data.unlink()
    (path / f".{data.name}.crc").unlink()
    for probe in (False, True):
        run = Run(Sources(spark, kept, probe_rows=probe), AssessmentConfig(as_of=AS_OF))
        rows = {r["question_id"]: r for r in scorecard(run).collect()}
        assert rows.keys() == card.keys()
        changed = {q for q in rows if rows[q]["status"] != card[q]["status"]}
        untouched = {q for q in rows if rows[q]["reason"] == card[q]["reason"]}
        assert changed and len(untouched) > 90


def test_a_bad_column_costs_only_its_readers(spark, card):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT}
    kept["query.history"] = kept["query.history"].withColumn(
        "read_bytes", F.raise_error(F.lit("bad block")).cast("bigint")
    )
    run = Run(Sources(spark, kept, probe_rows=False), AssessmentConfig(as_of=AS_OF))
    rows = {r["question_id"]: r for r in scorecard(run).collect()}
    for question_id in ("DG-01-03", "CO-03-04", "IU-03-02"):
        assert rows[question_id]["status"] == card[question_id]["status"]
        assert rows[question_id]["metrics_json"] == card[question_id]["metrics_json"]


def measured(sources, ids):
    run = Run(sources, AssessmentConfig(as_of=AS_OF))
    used = frozenset().union(*(decide(RULES[q], run, {})[1] for q in ids))
    work = Measurement(run, used)
    long, failed = work.result()
    return long, failed, used, work.further_jobs


def test_a_damaged_file_costs_one_more_job(spark, tmp_path):
    full = star_sources(spark, SF_DIR)
    path = tmp_path / "history"
    full.frame("query.history").limit(500).coalesce(1).write.parquet(str(path))
    (data,) = path.glob("part-*.parquet")
    history = spark.read.parquet(str(path))
    data.write_bytes(data.read_bytes()[: data.stat().st_size // 2])
    (path / f".{data.name}.crc").unlink()
    sources = Sources(spark, {"query.history": history}, probe_rows=False)
    long, failed, used, jobs = measured(sources, ["PE-03-03", "CO-02-01", "IU-01-03"])
    assert failed.keys() == {m for m in used if m.startswith("queries.")}
    assert jobs == 1


def test_a_bad_column_is_found_by_reading_columns_alone(spark):
    full = star_sources(spark, SF_DIR)
    bad = full.frame("query.history").limit(500).withColumn(
        "read_bytes", F.raise_error(F.lit("bad block")).cast("bigint")
    )
    sources = Sources(spark, {"query.history": bad}, probe_rows=False)
    ids = ["PE-03-03", "CO-02-01", "IU-01-03", "PE-02-08"]
    long, failed, used, jobs = measured(sources, ids)
    plan = PASSES["queries"].build(Run(sources, AssessmentConfig(as_of=AS_OF)))
    readers = {m for m, read in columns_read(plan, used).items() if "read_bytes" in read}
    assert readers and failed.keys() == readers
    assert {r["metric"] for r in long.collect()} == used - readers
    assert jobs <= len(plan.frame.columns) + 2


def test_a_failing_expression_is_given_up_after_some_jobs(spark, monkeypatch):
    full = star_sources(spark, SF_DIR)
    nodes = PASSES["nodes"]

    def build(run):
        plan = nodes.build(run)
        metrics = dict(plan.metrics)
        metrics["nodes.swap"] = Mean(F.raise_error(F.lit("no number")).cast("double"))
        return replace(plan, metrics=metrics)

    monkeypatch.setitem(PASSES, "nodes", replace(nodes, build=build))
    sources = Sources(
        spark, {"compute.node_timeline": full.frame("compute.node_timeline")}, probe_rows=False
    )
    run = Run(sources, AssessmentConfig(as_of=AS_OF))
    work = Measurement(run, nodes.build(run).metrics)
    long, failed = work.result()
    assert list(failed) == ["nodes.swap"]
    assert len(long.collect()) == len(nodes.build(run).metrics) - 1
    assert work.further_jobs <= 2 + RETRIES + len(SCHEMAS["compute.node_timeline"].split(","))


def test_sources_are_scanned_once():
    assert max(Counter(p.source for p in PASSES.values()).values()) == 1


def test_one_scan_and_no_lone_window_in_each_plan(spark):
    """Of every source the plan reads its table once; the scope is a kept frame."""
    run = Run(star_sources(spark, SF_DIR), AssessmentConfig(as_of=AS_OF))
    for name in ("queries", "tables", "usage", "clusters", "pipelines", "storage"):
        plan = PASSES[name].build(run)
        found, failed = measure(plan, plan.metrics)
        assert failed == {}
        text = found._jdf.queryExecution().sparkPlan().toString()
        assert text.count(f"{star_table(PASSES[name].source)}.parquet") == 1, name
        assert "windowspecdefinition(row_number" not in text


def test_passes_are_compiled_and_clients_make_no_groups(spark):
    """The JVM interprets methods over 8,000 bytes; groups must not multiply with clients."""
    run = Run(star_sources(spark, SF_DIR), AssessmentConfig(as_of=AS_OF))
    for name in ("queries", "audit", "usage", "jobs", "clusters"):
        plan = PASSES[name].build(run)
        found, failed = measure(plan, plan.metrics)
        assert failed == {} and found.collect()
        stages = found._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        assert 0 < max(sizes) <= 8000, (name, sizes)
    plan = PASSES["queries"].build(run)
    grouped = _Grouped(plan, plan.metrics).rows(plan.frame.withColumns(plan.features))
    principals = plan.frame.select("executed_by").distinct().count()
    assert grouped.where("_kind = ''").count() == principals
    assert grouped.count() < 2 * principals


def test_passes_over_logs_start_first(star_run):
    """The longest passes must not wait until all others are planned."""
    metrics = {"assistant.rows", "connections.rows", "jobs.total", "queries.all", "usage.rows"}
    work = Measurement(star_run, metrics)
    long, failed = work.result()
    assert failed == {} and {r["metric"] for r in long.collect()} == metrics
    assert list(work._jobs) == ["queries", "assistant", "jobs", "usage", "connections"]


def test_status_dependencies_of_all_rules(star_run):
    """A metric that changes any status, one changed at a time, is known to decide it."""
    rng = random.Random(5)
    specs = [RULES[q] for q in question_ids()]
    used = {s.question_id: decide(s, star_run, {})[1] for s in specs}
    numbers = sorted({m for found in used.values() for m in found})
    base = [{m: float(rng.choice([0, 1, 3, 40])) for m in numbers} for _ in range(3)]
    rows = [("", i, values, {}) for i, values in enumerate(base)]
    for m in numbers:
        rows += [
            (m, i, values | {m: v}, {}) for i, values in enumerate(base) for v in (0.0, 2.0, 99.0)
        ]
    frame = star_run.spark.createDataFrame(
        rows, f"metric string, base int, measured map<string,double>, mixes map<string,{MIX}>"
    )
    statuses = [decide(s, star_run, {})[0].status.alias(s.question_id) for s in specs]
    found = frame.select("metric", "base", *statuses).collect()
    plain = {r["base"]: r for r in found if r["metric"] == ""}
    changing = {
        (r["metric"], q)
        for r in found
        for q in used
        if r["metric"] and r[q] != plain[r["base"]][q]
    }
    assert changing
    for metric, question_id in changing:
        assert depends(RULES[question_id], star_run, metric), (metric, question_id)
    # A longer name that begins like another does not make that one decide.
    assert depends(RULES["PE-02-01"], star_run, "queries.finished_pruned")
    assert not depends(RULES["PE-02-01"], star_run, "queries.finished")


def test_side_signals_count_nothing_when_they_fail(spark):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT}
    kept["query.history"] = kept["query.history"].drop("statement_text")
    run = Run(Sources(spark, kept, probe_rows=False), AssessmentConfig(as_of=AS_OF))
    row = {r["question_id"]: r for r in scorecard(run, ["PE-02-09"]).collect()}["PE-02-09"]
    assert row["status"] == "completed"
    assert "queries.compaction" in json.loads(row["metrics_json"])["unmeasured"]
    assert "queries.compaction" in row["reason"]


def test_null_keys_in_a_mix(spark):
    full = star_sources(spark, SF_DIR)
    kept = {n: full.frame(n) for n in FLAT}
    kinds = kept["information_schema.table_constraints"]
    assert kinds.where("constraint_type IS NULL").count()
    run = Run(Sources(spark, kept, probe_rows=False), AssessmentConfig(as_of=AS_OF))
    (row,) = scorecard(run, ["R-02-04"]).collect()
    assert row["status"] != "open"


def test_scope_caveat(spark):
    sources = star_sources(spark, SF_DIR)
    rows = graded(sources, production_patterns=("nothing%",))
    assert rows["DG-01-02"]["reason"].startswith("[SCOPE:")
    assert rows["R-02-05"]["reason"].startswith("[SCOPE:")
    assert not rows["CO-01-06"]["reason"].startswith("[SCOPE:")


def test_excluded_principals(star_run):
    one = star_run.sources.frame("query.history").first()["executed_by"]
    config = AssessmentConfig(as_of=AS_OF, exclude_principals=(one,))
    row = answer(Run(star_run.sources, config), "IU-03-01").first()
    assert row["active_principals"] == 149


def test_inventory_marks_an_empty_collection(spark):
    items = spark.createDataFrame([("recipients", None)], SCHEMAS["workspace_inventory"])
    run = Run(Sources(spark, {"workspace_inventory": items}), AssessmentConfig(as_of=AS_OF))
    assert answer(run, "CO-03-05").first()["status"] == "completed"
    nothing = Run(
        Sources(spark, {"workspace_inventory": items.limit(0)}), AssessmentConfig(as_of=AS_OF)
    )
    assert answer(nothing, "CO-03-05").first()["status"] == "open"


def test_settings_are_checked():
    for bad in ({"complete_at": 0}, {"complete_at": 1.5}, {"lookback_days": 0}):
        with pytest.raises(ValueError, match="must be"):
            AssessmentConfig(**bad)
    with pytest.raises(ValueError, match="unknown areas"):
        questions_of(["nowhere"])
