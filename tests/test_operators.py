import random
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from posture.config import AssessmentConfig
from posture.operators.evidence import (
    Days,
    Distinct,
    Groups,
    GroupTest,
    Highest,
    Lowest,
    Mean,
    Pass,
    Rows,
    Top,
    TopK,
    Total,
    measure,
    mix_rows,
    top_k,
)
from posture.operators.latest import latest, newest_and_counts
from posture.operators.scope import resolve_scope, scope_frame
from posture.operators.windows import in_window


def values(frame):
    return {r["metric"]: r["value"] for r in frame.collect()}


def sample(seed, n=4000):
    """Rows where one key holds a third of everything."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None, "d e"])
        rows.append(
            (
                key,
                rng.choice(["x", "y", None]),
                rng.choice([None, 0, 1, 5, 9]),
                rng.choice([None, "d1", "d2", "d3"]) if rng.random() < 0.2 else None,
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("carrier", [("key",), ("key", "kind")])
def test_measure_matches_brute_force(spark, seed, carrier):
    rows = sample(seed)
    frame = spark.createDataFrame(rows, "key string, kind string, v int, dash string")
    big = F.col("v") > 1
    plan = Pass(
        frame,
        {
            "m.rows": Rows(),
            "m.big": Rows(big),
            "m.sum": Total(F.col("v")),
            "m.mean": Mean(F.col("v")),
            "m.low": Lowest(F.col("v")),
            "m.high": Highest(F.col("v")),
            "m.keys": Distinct("key"),
            "m.big_keys": Distinct("key", big),
            "m.dashes": Distinct("dash"),
            "m.big_dashes": Distinct("dash", big),
            "m.groups": Groups(big),
            "m.large": GroupTest(big, lambda n: n > 100),
        },
        carrier=carrier,
        spread={"dash": F.col("dash")},
    )
    found, failed = measure(plan, plan.metrics)
    got = values(found)
    present = [r[2] for r in rows if r[2] is not None]
    bigs = [r for r in rows if r[2] is not None and r[2] > 1]

    def group(r):
        return r[:1] if len(carrier) == 1 else r[:2]

    sizes = {}
    for r in bigs:
        sizes[group(r)] = sizes.get(group(r), 0) + 1
    assert failed == {}
    assert got == {
        "m.rows": len(rows),
        "m.big": len(bigs),
        "m.sum": sum(present),
        "m.mean": pytest.approx(sum(present) / len(present)),
        "m.low": 0,
        "m.high": 9,
        "m.keys": len({r[0] for r in rows} - {None}),
        "m.big_keys": len({r[0] for r in bigs} - {None}),
        "m.dashes": len({r[3] for r in rows} - {None}),
        "m.big_dashes": len({r[3] for r in bigs} - {None}),
        "m.groups": len([g for g in sizes if None not in g]),
        "m.large": len([g for g, n in sizes.items() if n > 100]),
    }


@pytest.mark.parametrize("carrier", [(), ("key",), ("key", "kind")])
@pytest.mark.parametrize("spread", [False, True])
def test_counts_and_mixes_of_one_scan(spark, carrier, spread):
    spread = {"dash": F.col("dash")} if spread else {}
    rng = random.Random(3)
    rows = [
        (*r, rng.choice([["p"], ["q", "p"], ["p", "q"], [], None]), rng.choice("ABCDEFG"), i % 200)
        for i, r in enumerate(sample(3))
    ]
    schema = "key string, kind string, v int, dash string, tags array<string>, tool string, d int"
    frame = spark.createDataFrame(rows, schema)
    big = F.col("v") > 1
    first = datetime(2024, 1, 1, tzinfo=UTC).date()
    metrics = {
        "m.rows": Rows(),
        "m.mean": Mean(F.col("v")),
        "m.high": Highest(F.col("v")),
        "m.tools": Top("tool", 3),
        "m.big_tools": Top("tool", 2, big),
        "m.kinds": Top("kind", None),
        "m.tags": Top("tag", 5, big),
        "m.tool_values": Distinct("tool", big),
        "m.kind_values": Distinct("kind"),
        "m.days": Days(F.date_add(F.lit(first), F.col("d")), first, 210),
    }
    if carrier:
        metrics |= {"m.groups": Groups(big), "m.large": GroupTest(big, lambda n: n > 100)}
    if spread:
        metrics["m.dashes"] = Distinct("dash", big)
    plan = Pass(
        frame, metrics, carrier=carrier, spread=spread,
        keys={"tool": F.col("tool"), "kind": F.col("kind"), "tag": F.col("tags")},
    )
    found, failed = measure(plan, metrics)
    assert failed == {}
    got = {
        r["metric"]: r["value"] if r["mix"] is None else [tuple(p) for p in r["mix"]]
        for r in found.collect()
    }
    bigs = [r for r in rows if r[2] is not None and r[2] > 1]
    present = [r[2] for r in rows if r[2] is not None]

    def most(values, k):
        return sorted(Counter(values).items(), key=lambda p: (-p[1], p[0]))[:k]

    expected = {
        "m.rows": len(rows),
        "m.mean": pytest.approx(sum(present) / len(present)),
        "m.high": 9,
        "m.tools": most([r[5] for r in rows], 3),
        "m.big_tools": most([r[5] for r in bigs], 2),
        "m.kinds": most([r[1] or "unknown" for r in rows], 50),
        "m.tags": most([t for r in bigs for t in r[4] or []], 5),
        "m.tool_values": len({r[5] for r in bigs}),
        "m.kind_values": 3,
        "m.days": 200,
    }
    if carrier:
        sizes = Counter(r[: len(carrier)] for r in bigs)
        expected["m.groups"] = len([g for g in sizes if None not in g])
        expected["m.large"] = len([g for g, n in sizes.items() if n > 100])
    if spread:
        expected["m.dashes"] = len({r[3] for r in bigs} - {None})
    assert got == expected
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Scan ExistingRDD") == 1 and "WindowGroupLimit" in text
    raw = [tuple(r) for r in mix_rows(plan, "m.kinds").collect()]
    assert sorted(raw, key=repr) == sorted(Counter(r[1] for r in rows).items(), key=repr)


@pytest.mark.parametrize("features", [False, True])
@pytest.mark.parametrize("keys", [False, True])
def test_mixes_of_a_spread_key(spark, features, keys):
    """A key with many values per carrier value adds its own groups, and none of both."""
    rng = random.Random(4)
    rows = [(*r, rng.choice(["A", "B", "C", "D", None]), f"u{i % 900}") for i, r in enumerate(sample(4))]
    schema = "key string, kind string, v int, dash string, tool string, user string"
    frame = spark.createDataFrame(rows, schema)
    big = F.col("_big") if features else F.col("v") > 1
    metrics = {
        "m.rows": Rows(),
        "m.big": Rows(big),
        "m.sum": Total(F.when(big, F.col("v"))),
        "m.users": Distinct("user", big),
        "m.tools": Top("tool", 3),
        "m.big_tools": Top("tool", None, big),
        "m.tool_values": Distinct("tool", big),
        "m.dashes": Distinct("dash"),
    }
    if keys:
        metrics["m.kinds"] = Top("kind", 2)
    plan = Pass(
        frame,
        metrics,
        features={"_big": F.col("v") > 1} if features else {},
        carrier=("user",),
        spread={"dash": F.col("dash"), "tool": F.col("tool")},
        keys={"kind": F.col("kind")} if keys else {},
    )
    found, failed = measure(plan, metrics)
    assert failed == {}
    got = {
        r["metric"]: r["value"] if r["mix"] is None else [tuple(p) for p in r["mix"]]
        for r in found.collect()
    }
    bigs = [r for r in rows if r[2] is not None and r[2] > 1]

    def most(values, k):
        return sorted(Counter(values).items(), key=lambda p: (-p[1], p[0]))[:k]

    expected = {
        "m.rows": len(rows),
        "m.big": len(bigs),
        "m.sum": sum(r[2] for r in bigs),
        "m.users": len({r[5] for r in bigs}),
        "m.tools": most([r[4] for r in rows if r[4]], 3),
        "m.big_tools": most([r[4] for r in bigs if r[4]], 50),
        "m.tool_values": len({r[4] for r in bigs} - {None}),
        "m.dashes": len({r[3] for r in rows} - {None}),
    }
    if keys:
        expected["m.kinds"] = most([r[1] or "unknown" for r in rows], 2)
    assert got == expected
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Scan ExistingRDD") == 1 and "WindowGroupLimit" in text
    tools = [tuple(r) for r in mix_rows(plan, "m.tools").collect()]
    assert tools == expected["m.tools"]


def test_newest_and_counts_pick_as_latest_does(spark):
    rng = random.Random(9)
    rows = [
        (rng.choice(["a", "b", "c", None, "hot", "hot"]), rng.choice([1, 2, 3, None]),
         rng.choice([None, None, 5]), i, {"k": str(i)})
        for i in range(400)
    ]
    schema = "id string, at int, gone int, name int, tags map<string,string>"
    frame = spark.createDataFrame(rows, schema)
    live = F.col("gone").isNull()
    for rank_first in (False, True):
        expected = latest(frame, "id", "at", live, rank_first).collect()
        got = newest_and_counts(
            frame, "id", "at", live, {"n": F.lit(True), "dead": ~live}, rank_first
        ).collect()
        assert sorted(r["name"] for r in got if r["is_newest"]) == sorted(r["name"] for r in expected)
        assert sum(r["n"] for r in got) == 400
        assert sum(r["dead"] for r in got) == len([r for r in rows if r[2]])
    nothing = newest_and_counts(frame, "id", "at", live, {}, among=F.lit(False)).collect()
    assert len(nothing) == 5 and not any(r["is_newest"] for r in nothing)


def test_measure_without_rows(spark):
    frame = spark.createDataFrame([], "key string, v int")
    plan = Pass(
        frame, {"m.rows": Rows(), "m.sum": Total(F.col("v")), "m.keys": Distinct("key")},
        carrier=("key",),
    )
    found, _ = measure(plan, plan.metrics)
    assert all(not v for v in values(found).values())


def test_measure_reports_missing_columns(spark):
    frame = spark.createDataFrame([("a", 1)], "key string, v int")
    plan = Pass(
        frame,
        {"m.ok": Rows(F.col("v") > 0), "m.bad": Rows(F.col("_text") == "x")},
        features={"_text": F.lower(F.col("no_such_column"))},
    )
    found, failed = measure(plan, plan.metrics)
    assert values(found) == {"m.ok": 1}
    assert list(failed) == ["m.bad"]


def test_two_level_combines_before_the_shuffle(spark):
    frame = spark.range(100).select((F.col("id") % 3).alias("key"))
    plan = Pass(frame, {"m.n": Rows(), "m.keys": Distinct("key")}, carrier=("key",))
    found, _ = measure(plan, plan.metrics)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text
    assert "Expand" not in text


def test_top_k_breaks_ties_by_key(spark):
    frame = spark.createDataFrame([(k,) for k in "bbaaccd"], "k string")
    assert [tuple(r) for r in top_k(TopK(frame, F.col("k"), 3)).collect()] == [
        ("a", 2), ("b", 2), ("c", 2),
    ]
    assert top_k(TopK(frame, F.col("k"), None)).count() == 4


VERSIONS = [
    # a deleted entity with an earlier live version, ties, a plain entity
    ("gone", 1, None, 1),
    ("gone", 2, 2, 2),
    ("tie", 5, None, 1),
    ("tie", 5, None, 9),
    ("kept", 1, None, 1),
    ("kept", 3, None, 2),
]


@pytest.mark.parametrize(
    ("rank_first", "expected"),
    [
        (False, {"gone": 1, "tie": 9, "kept": 2}),
        (True, {"tie": 9, "kept": 2}),
    ],
)
def test_latest_version(spark, rank_first, expected):
    frame = spark.createDataFrame(
        VERSIONS, "id string, change_time int, delete_time int, version int"
    )
    live = F.col("delete_time").isNull()
    got = latest(frame, "id", "change_time", live, rank_first).collect()
    assert {r["id"]: r["version"] for r in got} == expected


def test_latest_is_stable_without_a_version_column(spark):
    rows = [("k", 1, f"v{i}", {"a": str(i)}) for i in range(50)]
    schema = "id string, at int, name string, tags map<string,string>"
    picks = set()
    for parts in (1, 3, 8):
        frame = spark.createDataFrame(rows, schema).repartition(parts)
        picks.add(latest(frame, "id", "at", F.lit(True)).first()["name"])
    assert len(picks) == 1


def test_latest_prunes_before_the_shuffle(spark):
    frame = spark.createDataFrame(VERSIONS, "id string, change_time int, d int, version int")
    text = latest(frame, "id", "change_time", F.lit(True))._jdf.queryExecution()
    assert "WindowGroupLimit" in text.executedPlan().toString()


CATALOGS = ["system", "samples", "prod_sales", "main", "it's_prod", "dev"]


def test_scope_of_production(spark):
    frame = spark.createDataFrame([(c,) for c in CATALOGS], "catalog_name string")
    scope = resolve_scope(frame, AssessmentConfig())
    assert scope.mode == "prod"
    assert scope.size == 3
    assert scope.caveat == ""
    tables = spark.createDataFrame(
        [
            ("prod_sales", "a"), ("prod_sales", "my_dev"), ("main", "Information_Schema"),
            ("it's_prod", "b"), ("dev", "a"), (None, "a"),
        ],
        "c string, s string",
    )
    kept = {(r.c, r.s) for r in scope.restrict(tables, "c", "s").collect()}
    assert kept == {("prod_sales", "a"), ("it's_prod", "b")}
    marked = scope.mark(tables, "c", "s")
    assert marked.count() == 6
    assert {(r.c, r.s) for r in marked.where("in_scope").collect()} == kept


def test_scope_falls_back_and_may_be_empty(spark):
    config = AssessmentConfig(production_patterns=("nothing%",))
    frame = spark.createDataFrame([(c,) for c in CATALOGS], "catalog_name string")
    scope = resolve_scope(frame, config)
    assert (scope.mode, scope.size) == ("all", 4)
    assert scope.caveat.startswith("[SCOPE:")
    names = {r["catalog_name"] for r in scope_frame(frame, config).collect()}
    assert names == {r["catalog_name"] for r in scope.frame.collect()} and len(names) == 4
    plan = scope_frame(frame, config)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan
    nothing = resolve_scope(frame.limit(0), config)
    assert nothing.size == 0
    assert nothing.restrict(frame, "catalog_name").count() == 0
    # Without system patterns the negated match keeps nothing.
    assert resolve_scope(frame, AssessmentConfig(system_catalogs=())).size == 0


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_window_includes_its_first_instant(spark, kind):
    config = AssessmentConfig(as_of=datetime(2024, 1, 31, tzinfo=UTC), lookback_days=30)
    stamps = ["2024-01-01 00:00:00", "2023-12-31 23:59:59", "2024-01-15 00:00:00"]
    frame = spark.createDataFrame([(s,) for s in stamps], "s string").select(
        F.col("s").cast(kind).alias("at")
    )
    assert in_window(frame, "at", config).count() == 2


def test_tie_break_of_nested_columns_without_json(spark):
    rows = [(1, 5, {"a": "x", "b": "y"}, ["p"]), (1, 5, {"b": "y", "a": "z"}, None), (1, 5, None, [])]
    schema = "id int, at int, tags map<string,string>, kinds array<string>"
    picks = set()
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        frame = spark.createDataFrame(order, schema).repartition(3)
        newest = latest(frame, "id", "at", F.lit(True))
        picks.add(str(newest.first()))
        assert "to_json" not in newest._jdf.queryExecution().toString()
    assert len(picks) == 1
