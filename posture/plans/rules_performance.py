"""Rules: performance efficiency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posture import fixed_values as fixed
from posture.fixed_values import COMPLETED, IN_PROGRESS, OPEN
from posture.functions.grading import (
    billed,
    decimal,
    percent,
    percent_text,
    rounded,
    sentence,
    whole,
)
from posture.plans.rules import Evidence, Verdict, manual, question

HISTORY = "query.history"
CLUSTERS = "compute.clusters"
STORAGE = "storage.table_metrics_history"


def _gigabytes(size: Column) -> Column:
    return F.concat(decimal(size / 1e9), F.lit(" GB"))


@question("PE-01-01", "billing.usage")
def serverless_architecture(e: Evidence) -> Verdict:
    return e.ratio(
        rounded(e.x("usage.serverless")),
        billed(e.x("usage.total")),
        "usage units ran on serverless compute",
        nothing=f"No billed usage in {e.config.lookback_days} days.",
        metrics={
            "serverless_dbus": F.round(e.x("usage.serverless"), 2),
            "total_dbus": F.round(e.x("usage.total"), 2),
        },
    )


@question("PE-01-02", "serving.served_entities")
def enterprise_serving(e: Evidence) -> Verdict:
    endpoints, reserved = e.n("served.endpoints"), e.n("served.provisioned")
    kinds = {k: e.n(f"served.{k}") for k in ("foundation", "external", "custom")}
    return Verdict(
        F.when(endpoints == 0, OPEN).otherwise(COMPLETED),
        sentence(
            "{} endpoint(s) serve {} foundation, {} external and {} custom model(s); {} have"
            " reserved throughput.",
            whole(endpoints), *(whole(k) for k in kinds.values()), whole(reserved),
        ),
        {"endpoints": endpoints, **kinds, "provisioned_throughput": reserved},
    )


@question("PE-02-01", HISTORY)
def access_patterns(e: Evidence) -> Verdict:
    queries = e.n("queries.finished")
    pruned, opened = e.n("queries.finished_pruned"), e.n("queries.finished_opened")
    return e.ratio(
        pruned,
        pruned + opened,
        "files were pruned instead of read",
        complete_at=fixed.HALF,
        nothing="No finished queries with file counts.",
        extra=sentence(
            "{} finished query/queries read {}, {}% from the disk cache on average.",
            whole(queries), _gigabytes(e.x("queries.finished_bytes")),
            decimal(e.x("queries.finished_io_cache")),
        ),
        metrics={"queries": queries, "pruned_files": pruned, "read_files": opened},
    )


@question("PE-02-02", HISTORY)
def parallel_reads(e: Evidence) -> Verdict:
    queries, parallel = e.n("queries.reading"), e.n("queries.reading_parallel")
    return e.ratio(
        parallel,
        queries,
        "reading queries scan several partitions",
        extra=sentence(
            "{} partition(s) per query on average.", decimal(e.x("queries.reading_partitions"))
        ),
        metrics={"queries": queries, "parallel_queries": parallel},
    )


@question("PE-02-03", HISTORY)
def execution_chain(e: Evidence) -> Verdict:
    total, executing = e.n("queries.total_ms"), e.n("queries.execution_ms")
    phases = {
        "waiting": e.n("queries.compute_wait_ms") + e.n("queries.capacity_wait_ms"),
        "compilation": e.n("queries.compile_ms"),
        "result fetch": e.n("queries.fetch_ms"),
    }
    # The first of equally large phases wins.
    longest = F.greatest(*phases.values())
    worst = F.coalesce(*(F.when(ms == longest, F.lit(name)) for name, ms in phases.items()))
    return e.ratio(
        executing,
        F.when(total > 0, total).otherwise(0),
        "query time was spent executing",
        nothing="No finished queries with timings.",
        extra=sentence(
            "Elsewhere: waiting {}, compilation {}, result fetch {}; the longest is {}.",
            *(percent_text(percent(ms, total) / 100) for ms in phases.values()),
            worst,
        ),
        metrics={
            "queries": e.n("queries.finished"),
            "total_ms": total,
            "exec_ms": executing,
            "wait_ms": phases["waiting"],
            "compile_ms": phases["compilation"],
            "fetch_ms": phases["result fetch"],
            "worst_phase": worst,
        },
    )


@question("PE-02-04", CLUSTERS)
def larger_clusters(e: Evidence) -> Verdict:
    total, single = e.n("clusters.total"), e.n("clusters.single_node")
    verdict = e.ratio(
        e.n("clusters.multi_worker"),
        total,
        "recent clusters have two or more workers",
        nothing="No clusters to size: serverless compute sizes itself.",
        extra=sentence(
            "{} worker(s) on average, {} single-node cluster(s).",
            decimal(e.x("clusters.workers")), whole(single),
        ),
        metrics={"single_node": single, "avg_workers": F.round(e.x("clusters.workers"), 2)},
    )
    return Verdict(
        F.when(total == 0, COMPLETED).otherwise(verdict.status), verdict.reason, verdict.metrics
    )


@question("PE-02-05", HISTORY, scoped=True)
def native_operations(e: Evidence) -> Verdict:
    total, defining = e.n("queries.all"), e.n("queries.function_definitions")
    foreign, sql = e.n("routines.foreign"), e.n("routines.sql")
    return e.ratio(
        total - defining,
        total,
        "statements define no scalar function",
        nothing=f"No queries in {e.config.lookback_days} days.",
        extra=sentence(
            "{} function(s) in scope are not SQL, {} are.", whole(foreign), whole(sql)
        ),
        metrics={
            "udf_definition_statements": defining,
            "python_routines": foreign,
            "sql_routines": sql,
        },
    )


@question("PE-02-06", "billing.usage")
def native_engine(e: Evidence) -> Verdict:
    total, photon, sql = e.x("usage.total"), e.x("usage.photon"), e.x("usage.sql")
    zero = F.lit(0.0)
    vectorized = F.greatest(photon, zero) + F.greatest(sql - photon, zero)
    return e.ratio(
        rounded(F.least(vectorized, total)),
        billed(total),
        "usage units ran on the vectorized engine",
        nothing=f"No billed usage in {e.config.lookback_days} days.",
        extra=sentence("Flagged: {}; warehouse: {}.", whole(photon), whole(sql)),
        metrics={
            "photon_dbus": F.round(photon, 2),
            "sql_dbus": F.round(sql, 2),
            "total_dbus": F.round(total, 2),
        },
    )


@question("PE-02-07", "compute.node_timeline")
def hardware_fit(e: Evidence) -> Verdict:
    clusters = e.n("nodes.clusters")
    cpu, memory = e.x("nodes.cpu"), e.x("nodes.memory")
    waiting, swap = e.x("nodes.io_wait"), e.x("nodes.swap")
    problems = F.concat_ws(
        "; ",
        F.when(swap > fixed.SWAP_PERCENT, "memory pressure"),
        F.when(waiting > fixed.IO_WAIT_PERCENT, "waits for storage"),
        F.when(memory > fixed.MEMORY_PERCENT, "memory nearly full"),
        F.when(cpu < fixed.IDLE_CPU_PERCENT, "idle processors"),
    )
    return Verdict(
        F.when(clusters == 0, OPEN).when(problems != "", IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} cluster(s) over {} days: processor {}%, memory {}%, storage wait {}%, swap {}%."
            " Problems: {}.",
            whole(clusters), F.lit(str(fixed.NODE_WINDOW_DAYS)), decimal(cpu), decimal(memory),
            decimal(waiting), decimal(swap),
            F.when(problems == "", "none").otherwise(problems),
        ),
        {
            "clusters": clusters,
            "avg_cpu_pct": F.round(cpu, 2),
            "avg_mem_pct": F.round(memory, 2),
            "avg_iowait_pct": F.round(waiting, 2),
            "avg_swap_pct": F.round(swap, 2),
        },
    )


@question("PE-02-08", HISTORY)
def caching(e: Evidence) -> Verdict:
    queries, hits = e.n("queries.finished"), e.n("queries.finished_from_cache")
    cached = e.x("queries.finished_io_cache")
    return Verdict(
        F.when(queries == 0, OPEN)
        .when(cached >= fixed.IO_CACHE_PERCENT, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{}% of reads came from the disk cache on average over {} finished query/queries;"
            " {} were answered from the result cache.",
            decimal(cached), whole(queries), whole(hits),
        ),
        {
            "queries": queries,
            "avg_io_cache_pct": F.round(cached, 2),
            "result_cache_hits": hits,
        },
    )


UPKEEP = "storage.predictive_optimization_operations_history"


@question("PE-02-09", UPKEEP)
def compaction(e: Evidence) -> Verdict:
    operations, tables = e.n("upkeep.operations"), e.n("upkeep.tables")
    by_hand = e.n("queries.compaction")
    return Verdict(
        F.when((operations == 0) & (by_hand == 0), OPEN)
        .when(operations > 0, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} automatic operation(s) on {} table(s) and {} manual statement(s) in {} days.",
            whole(operations), whole(tables), whole(by_hand), e.days,
        ),
        {"po_operations": operations, "po_tables": tables, "manual_optimize": by_hand},
    )


@question("PE-02-10", HISTORY)
def data_skipping(e: Evidence) -> Verdict:
    pruned, opened = e.n("queries.finished_pruned"), e.n("queries.finished_opened")
    queries, clustering = e.n("queries.with_file_counts"), e.n("queries.clustering")
    return e.ratio(
        pruned,
        pruned + opened,
        "candidate files were skipped",
        complete_at=fixed.HALF,
        nothing="No queries with file counts.",
        extra=sentence(
            "{} query/queries with file counts; {} statement(s) cluster data.",
            whole(queries), whole(clustering),
        ),
        metrics={
            "queries": queries,
            "pruned_files": pruned,
            "read_files": opened,
            "clustering_statements": clustering,
        },
    )


@question("PE-02-11", STORAGE, scoped=True)
def automatic_upkeep(e: Evidence) -> Verdict:
    return e.ratio(
        e.n("storage.automatic"),
        e.n("storage.tables"),
        f"tables in {e.where} are kept up automatically",
    )


@question("PE-02-12", "information_schema.columns", scoped=True)
def partition_depth(e: Evidence) -> Verdict:
    total, heavy = e.n("columns.tables"), e.n("columns.heavily_partitioned")
    plain, light = e.n("columns.unpartitioned"), e.n("columns.lightly_partitioned")
    small = e.n("storage.small")
    return e.ratio(
        total - heavy,
        total,
        f"tables in {e.where} have at most two partition columns",
        extra=sentence(
            "{} without partitions, {} with one or two, {} with more; {} table(s) are under"
            " 1 GB.",
            whole(plain), whole(light), whole(heavy), whole(small),
        ),
        metrics={
            "unpartitioned": plain,
            "lightly_partitioned": light,
            "heavily_partitioned": heavy,
            "small_tables": small,
        },
    )


@question("PE-02-14", STORAGE, scoped=True)
def file_sizes(e: Evidence) -> Verdict:
    small, mean = e.n("storage.small_files"), e.x("storage.file_bytes") / 1_048_576
    return e.ratio(
        e.n("storage.healthy_files"),
        e.n("storage.with_files"),
        f"tables in {e.where} average 16 MB or more per file",
        extra=sentence(
            "{} MB per file on average; {} table(s) are below 16 MB.",
            decimal(mean), whole(small),
        ),
        metrics={"small_file_tables": small, "avg_file_mb": F.round(mean, 2)},
    )


@question("PE-02-15", HISTORY)
def join_spill(e: Evidence) -> Verdict:
    joins, spilling = e.n("queries.joins"), e.n("queries.joins_spilling")
    shuffled, read = e.n("queries.joins_shuffled"), e.n("queries.joins_read")
    return e.ratio(
        joins - spilling,
        joins,
        "join queries finished without spilling",
        nothing=f"No join queries in {e.config.lookback_days} days.",
        extra=sentence("They shuffled {} and read {}.", _gigabytes(shuffled), _gigabytes(read)),
        metrics={
            "join_queries": joins,
            "spilling_queries": spilling,
            "shuffle_bytes": shuffled,
            "read_bytes": read,
        },
    )


@question("PE-02-16")
def table_statistics(e: Evidence) -> Verdict:
    statements, automatic = e.n("queries.statistics"), e.n("upkeep.statistics")
    return Verdict(
        F.when((statements == 0) & (automatic == 0), OPEN)
        .when(automatic > 0, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} statistics statement(s) and {} automatic operation(s) in {} days.",
            whole(statements), whole(automatic), e.days,
        ),
        {"analyze_statements": statements, "po_statistics_operations": automatic},
    )


manual(
    "PE-03-01",
    "whether test data resembles production is a property of the test process.",
    "how test data is made and how its volume compares with production.",
)


@question("PE-03-02", HISTORY)
def warm_compute(e: Evidence) -> Verdict:
    queries, cold = e.n("queries.finished"), e.n("queries.cold_starts")
    waited, total = e.n("queries.compute_wait_ms"), e.n("queries.total_ms")
    return e.ratio(
        queries - cold,
        queries,
        "queries waited at most 10 seconds for compute",
        nothing=f"No finished queries in {e.config.lookback_days} days.",
        extra=sentence(
            "Waiting took {} of query time; {} query/queries started cold.",
            percent_text(percent(waited, total) / 100), whole(cold),
        ),
        metrics={"cold_start_queries": cold, "wait_ms": waited, "total_ms": total},
    )


@question("PE-03-03", HISTORY)
def bottlenecks(e: Evidence) -> Verdict:
    queries = e.n("queries.finished")
    spilling, heavy = e.n("queries.spilling"), e.n("queries.shuffle_heavy")
    queued = e.n("queries.finished_queued")
    healthy = F.greatest(queries - F.greatest(spilling, heavy, queued), F.lit(0))
    return e.ratio(
        healthy,
        queries,
        "finished queries show no bottleneck",
        nothing=f"No finished queries in {e.config.lookback_days} days.",
        extra=sentence(
            "{} spill, {} shuffle more than they read, {} queued for capacity.",
            whole(spilling), whole(heavy), whole(queued),
        ),
        metrics={
            "queries": queries,
            "spilling": spilling,
            "shuffle_heavy": heavy,
            "queued": queued,
        },
    )


@question("PE-04-01", HISTORY)
def query_monitoring(e: Evidence) -> Verdict:
    days, watchers = e.n("queries.days"), e.n("queries.history")
    return Verdict(
        F.when(days == 0, OPEN).when(watchers == 0, IN_PROGRESS).otherwise(COMPLETED),
        sentence(
            "{} query/queries read the query log over {} day(s) of history.",
            whole(watchers), whole(days),
        ),
        {"history_days": days, "monitoring_queries": watchers},
    )


@question("PE-04-02")
def stream_monitoring(e: Evidence) -> Verdict:
    pipelines, updates = e.n("pipelines.continuous_versions"), e.n("pipeline_updates.rows")
    return Verdict(
        F.when((pipelines == 0) & (updates == 0), OPEN)
        .when(updates > 0, COMPLETED)
        .otherwise(IN_PROGRESS),
        sentence(
            "{} continuous pipeline(s) and {} pipeline update(s) in {} days.",
            whole(pipelines), whole(updates), e.days,
        ),
        {"continuous_pipelines": pipelines, "pipeline_updates": updates},
    )


@question("PE-04-03", "lakeflow.job_run_timeline")
def job_monitoring(e: Evidence) -> Verdict:
    runs, jobs = e.n("job_runs.ended"), e.n("job_runs.jobs")
    rules = e.n("jobs.with_health_rules")
    verdict = e.ratio(
        rules,
        e.n("jobs.total"),
        "live jobs have health rules",
        metrics={"runs": runs, "jobs_run": jobs, "jobs_with_health_rules": rules},
    )
    return Verdict(
        F.when(runs == 0, OPEN).otherwise(verdict.status),
        F.when(runs == 0, f"No job runs were recorded in {e.config.lookback_days} days.").otherwise(
            F.concat(
                verdict.reason,
                sentence(
                    " {} run(s) of {} job(s), {} s running and {} s queued on average.",
                    whole(runs), whole(jobs), whole(e.x("job_runs.run_seconds")),
                    whole(e.x("job_runs.queue_seconds")),
                ),
            )
        ),
        verdict.metrics,
    )
