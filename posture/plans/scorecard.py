"""From sources to one graded row per question."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posture.operators import evidence as measuring
from posture.operators.evidence import EVIDENCE, columns_read, measure
from posture.operators.run import Run
from posture.plans import (  # noqa: F401 - registers passes and rules
    activity,
    configuration,
    consumption,
    learning,
    metadata,
    rules_cost,
    rules_governance,
    rules_interoperability,
    rules_operations,
    rules_performance,
    rules_reliability,
)
from posture.plans.bank import question_bank, questions
from posture.plans.passes import PASSES, pass_of
from posture.plans.rules import RULES, RuleSpec, Verdict, decide, ordered

log = logging.getLogger(__name__)
Failures = dict[str, str]
#: Jobs in which a pass with a failing expression is measured again.
RETRIES = 16


def question_ids() -> list[str]:
    """Questions with a rule, in bank order."""
    return [q.question_id for q in questions() if q.question_id in RULES]


def check_coverage(ids: Iterable[str] | None = None) -> None:
    """Fail when the rules and the bank's measured areas drift apart."""
    got = set(RULES if ids is None else ids)
    known = {q.question_id for q in questions()}
    areas = {q.pillar_id for q in questions() if q.question_id in got}
    expected = {q.question_id for q in questions() if q.pillar_id in areas}
    if expected - got:
        raise AssertionError(f"no rule for {sorted(expected - got)}")
    if got - known:
        raise AssertionError(f"unknown questions {sorted(got - known)}")


def _by_pass(metrics: Iterable[str]) -> dict[str, list[str]]:
    """The metrics of each pass, in the order of registration: activity logs come first.

    Passes start as they are planned, so the longest ones run while the others are planned.
    """
    found: dict[str, list[str]] = defaultdict(list)
    for metric in sorted(metrics):
        found[metric.split(".", 1)[0]].append(metric)
    place = {name: i for i, name in enumerate(PASSES)}
    return dict(sorted(found.items(), key=lambda item: place.get(item[0], len(place))))


def _plan_pass(run: Run, name: str, metrics: list[str]) -> tuple[DataFrame | None, Failures]:
    try:
        return measure(PASSES[name].build(run), metrics)
    except Exception as problem:  # a pass that cannot be planned fails alone
        return None, dict.fromkeys(metrics, _message(problem))


def evidence_passes(
    run: Run, metrics: Iterable[str]
) -> tuple[dict[str, DataFrame], Failures]:
    """One long-evidence DataFrame per pass, and the metrics that do not resolve."""
    frames: dict[str, DataFrame] = {}
    failed: Failures = {}
    for name, names in _by_pass(metrics).items():
        frame, problems = _plan_pass(run, name, names)
        failed.update(problems)
        if frame is not None:
            frames[name] = frame
    return frames, failed


class Measurement:
    """All passes as concurrent jobs, each started as soon as it is planned.

    One job per pass keeps every plan small, lets passes share the cluster, and
    confines a failing source to its own questions. A pass answers with one row per
    metric, so what comes back is a few hundred numbers whatever the data size.
    """

    def __init__(self, run: Run, metrics: Iterable[str]):
        self._run = run
        self._failed: Failures = {}
        self._retries = RETRIES
        #: Jobs that failures cost beside the one of each pass.
        self.further_jobs = 0
        self._jobs: dict[str, tuple[list[str], Future]] = {}
        self._pool = ThreadPoolExecutor(run.config.concurrent_passes)
        inherit = inheritable_thread_target(run.spark)
        for name, names in _by_pass(metrics).items():
            frame, problems = _plan_pass(run, name, names)
            self._failed.update(problems)
            if frame is not None:
                job = self._pool.submit(inherit(frame.collect))
                self._jobs[name] = (names, job)

    def result(self) -> tuple[DataFrame, Failures]:
        """The evidence so far as a local DataFrame; waits for all jobs."""
        rows = []
        try:
            for name, (names, job) in self._jobs.items():
                try:
                    rows += job.result()
                except Exception as problem:  # whatever ends a job, as a corrupt or missing file
                    log.warning("pass %s failed: %s", name, _message(problem))
                    left = [n for n in names if n not in self._failed]
                    rows += self._isolate(name, left, problem)
        finally:
            self._pool.shutdown(cancel_futures=True)
        return self._run.spark.createDataFrame(rows, EVIDENCE), self._failed

    def _isolate(self, name: str, metrics: list[str], problem: Exception) -> list:
        """What a failed pass still has, at the price of a few further jobs.

        One job that only counts tells a source that cannot be read at all; then every
        column is read alone, side by side, which costs one more scan in all. Metrics of
        sound columns are measured again in one job. If all columns are sound, an
        expression fails: metrics are measured again in halves, ``RETRIES`` jobs at most.
        """
        plan = PASSES[name].build(self._run)
        if self._fails(plan.frame.agg(F.count(F.lit(1)))):
            self._failed.update(dict.fromkeys(metrics, _message(problem)))
            return []
        read = columns_read(plan, metrics)
        columns = sorted(frozenset().union(*read.values()))
        inherit = inheritable_thread_target(self._run.spark)
        with ThreadPoolExecutor(self._run.config.concurrent_passes) as pool:
            probes = {
                c: pool.submit(
                    inherit(self._fails),
                    plan.frame.agg(F.max(F.length(F.col(f"`{c}`").cast("string")))),
                )
                for c in columns
            }
            bad = {c: why for c, probe in probes.items() if (why := probe.result())}
        sound = [m for m in metrics if not read[m] & bad.keys()]
        for metric in set(metrics) - set(sound):
            self._failed[metric] = bad[min(read[metric] & bad.keys())]
        if not sound:
            return []
        self._retries = RETRIES
        return self._again(name, sound) if bad else self._halves(name, sound, problem)

    def _fails(self, probe: DataFrame) -> str | None:
        self.further_jobs += 1
        try:
            probe.collect()
        except Exception as problem:
            return _message(problem)
        return None

    def _again(self, name: str, metrics: list[str]) -> list:
        frame, problems = _plan_pass(self._run, name, metrics)
        self._failed.update(problems)
        if frame is None:
            return []
        self.further_jobs += 1
        try:
            return frame.collect()
        except Exception as problem:
            return self._halves(name, [m for m in metrics if m not in problems], problem)

    def _halves(self, name: str, metrics: list[str], problem: Exception) -> list:
        if len(metrics) < 2 or self._retries < 2:
            self._failed.update(dict.fromkeys(metrics, _message(problem)))
            return []
        self._retries -= 2
        middle = len(metrics) // 2
        return self._again(name, metrics[:middle]) + self._again(name, metrics[middle:])


def _message(problem: Exception) -> str:
    return " ".join(f"{type(problem).__name__}: {problem}".split("\n"))[:600]


def _union(frames: list[DataFrame]) -> DataFrame:
    """Pairwise union; a chain of many unions is slow to analyze."""
    while len(frames) > 1:
        pairs = zip(frames[::2], frames[1::2], strict=False)
        odd = frames[-1:] if len(frames) % 2 else []
        frames = [a.unionByName(b) for a, b in pairs] + odd
    return frames[0]


def _evidence_row(long: DataFrame) -> DataFrame:
    """One row with all measured values and mixes; a few hundred entries in total."""
    number = F.struct("metric", "value")
    pairs = F.struct("metric", "mix")
    return long.agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("mix").isNull(), number))
        ).alias("measured"),
        F.map_from_entries(F.collect_list(F.when(F.col("mix").isNotNull(), pairs))).alias(
            "mixes"
        ),
    )


Graded = tuple[DataFrame, dict[str, Verdict]]


def _first_verdicts(
    run: Run, ids: Iterable[str]
) -> tuple[list[RuleSpec], dict[str, Verdict], dict[str, frozenset[str]]]:
    specs = ordered(ids)
    decided = {s.question_id: decide(s, run, {}) for s in specs}
    return (
        specs,
        {q: verdict for q, (verdict, _) in decided.items()},
        {q: used for q, (_, used) in decided.items()},
    )


def _final_verdicts(
    run: Run,
    specs: Iterable[RuleSpec],
    verdicts: dict[str, Verdict],
    used: Mapping[str, frozenset[str]],
    failed: Failures,
) -> dict[str, Verdict]:
    return {
        s.question_id: decide(s, run, failed)[0]
        if failed.keys() & used[s.question_id]
        else verdicts[s.question_id]
        for s in specs
    }


def lazily_graded(run: Run, ids: Iterable[str]) -> Graded:
    """The evidence row as one plan over all passes, and a verdict per question."""
    specs, verdicts, used = _first_verdicts(run, ids)
    frames, failed = evidence_passes(run, frozenset().union(*used.values()))
    row = _evidence_row(_union([run.spark.createDataFrame([], EVIDENCE), *frames.values()]))
    return row, _final_verdicts(run, specs, verdicts, used, failed)


def _caveated(run: Run, question_id: str, reason: Column) -> Column:
    if RULES[question_id].caveat and run.scope is not None and run.scope.caveat:
        return F.concat(F.lit(run.scope.caveat), reason)
    return reason


def _metrics_json(question_id: str, verdict: Verdict) -> Column:
    metrics = dict(verdict.metrics)
    if RULES[question_id].caveat:
        metrics["scoped"] = F.lit(True)
    if not metrics:
        return F.lit("{}")
    return F.to_json(
        F.struct(*(c.alias(n) for n, c in metrics.items())), {"ignoreNullFields": "false"}
    )


def _card(run: Run, question_id: str, verdict: Verdict) -> Column:
    return F.struct(
        F.lit(question_id).alias("question_id"),
        verdict.status.alias("status"),
        _caveated(run, question_id, verdict.reason).alias("reason"),
        _metrics_json(question_id, verdict).alias("metrics_json"),
    )


def scorecard(run: Run, ids: Iterable[str] | None = None) -> DataFrame:
    """One row per question in the shape of the result table, plus report order.

    Measures on call; grading is left to the returned DataFrame. Columns: run_id,
    run_timestamp, pillar, question_id, principle, question, status, reason,
    metrics_json, pillar_ordinal, ordinal.
    """
    specs, first, used = _first_verdicts(run, question_ids() if ids is None else ids)
    measurement = Measurement(run, frozenset().union(*used.values()))
    cards = {q: _card(run, q, v) for q, v in first.items()}
    long, failed = measurement.result()
    for q, verdict in _final_verdicts(run, specs, first, used, failed).items():
        if verdict is not first[q]:
            cards[q] = _card(run, q, verdict)
    rows = _evidence_row(long).select(F.inline(F.array(*cards.values())))
    bank = question_bank(run.spark)
    return rows.join(F.broadcast(bank), "question_id", "left").select(
        F.lit(run.config.run_id).alias("run_id"),
        F.lit(run.config.as_of.isoformat()).cast("timestamp").alias("run_timestamp"),
        F.coalesce("pillar", F.lit("")).alias("pillar"),
        "question_id",
        F.coalesce("principle", F.lit("")).alias("principle"),
        F.coalesce("question", F.lit("")).alias("question"),
        "status",
        "reason",
        "metrics_json",
        "pillar_ordinal",
        "ordinal",
    )


DERIVED_METRICS = {"pct", "complete_at_pct"}


def answer(run: Run, question_id: str) -> DataFrame:
    """One question on its own: status and its metrics as columns.

    Only the passes and columns this question needs are planned.
    """
    evidence, verdicts = lazily_graded(run, [question_id])
    verdict = verdicts[question_id]
    metrics = [
        c.alias(n) for n, c in verdict.metrics.items() if n not in DERIVED_METRICS
    ]
    return evidence.select(
        F.lit(question_id).alias("question_id"), verdict.status.alias("status"), *metrics
    )


MIXES = {
    "formats": "tables.formats",
    "closed_formats": "tables.closed_formats",
    "unsafe_formats": "tables.unsafe_formats",
    "constraint_kinds": "constraints.kinds",
    "clients": "queries.clients",
    "tag_keys": "usage.tag_keys",
    "node_types": "clusters.node_types",
}


def mix_rows(run: Run, name: str) -> DataFrame:
    """A top-k measurement as ``(key, n)`` rows."""
    metric = MIXES[name]
    return measuring.mix_rows(pass_of(metric).build(run), metric)
