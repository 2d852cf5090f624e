import pytest
from pyspark.sql import functions as F

from posture.functions import grading
from posture.functions.text import any_like, filled_json, has_any, non_blank

RATIOS = [
    (0, 0, 0.8, "open"),
    (None, None, 0.8, "open"),
    (5, None, 0.8, "open"),
    (None, 100, 0.8, "open"),
    (0, 100, 0.8, "in-progress"),
    (79, 100, 0.8, "in-progress"),
    (80, 100, 0.8, "completed"),
    (100, 100, 0.8, "completed"),
    (431, 691, 0.8, "in-progress"),
    (50, 100, 0.5, "completed"),
    (150, 100, 0.8, "completed"),
]


@pytest.mark.parametrize(("part", "total", "bar", "expected"), RATIOS)
def test_ratio_status(spark, part, total, bar, expected):
    row = spark.createDataFrame([(part, total)], "p bigint, t bigint")
    got = row.select(grading.ratio_status(F.col("p"), F.col("t"), bar)).first()[0]
    assert got == expected


def test_ratio_percent(spark):
    row = spark.createDataFrame([(431, 691)], "p bigint, t bigint")
    share = grading.percent(F.col("p"), F.col("t"))
    assert row.select(F.round(share, 2)).first()[0] == 62.37
    assert row.select(grading.percent_text(share / 100)).first()[0] == "62.4%"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_presence_signals_and_downgrade(spark):
    lit = F.lit
    got = one(
        spark,
        grading.presence_status(lit(None).cast("bigint")),
        grading.presence_status(lit(0)),
        grading.presence_status(lit(2), 3),
        grading.presence_status(lit(3), 3),
        grading.signal_status(lit(0), lit(0)),
        grading.signal_status(lit(0), lit(7)),
        grading.signal_status(lit(1), lit(7), lit(None).cast("bigint")),
        grading.downgrade(lit("completed"), lit(True)),
        grading.downgrade(lit("completed"), lit(False)),
        grading.downgrade(lit("open"), lit(True)),
    )
    assert got == (
        "open", "open", "in-progress", "completed", "open", "in-progress", "completed",
        "in-progress", "completed", "open",
    )


def test_rounding_and_wording(spark):
    lit = F.lit
    got = one(
        spark,
        grading.rounded(lit(2.5)),
        grading.rounded(lit(3.5)),
        grading.billed(lit(-4.0)),
        grading.percent_text(lit(None).cast("double")),
        grading.sentence("100% of {} in {}", grading.whole(lit(1234567)), lit("x")),
        grading.known(lit(None).cast("bigint")),
    )
    assert got == (2, 4, 0, "n/a", "100% of 1,234,567 in x", "unknown")


def test_sentence_checks_its_values():
    with pytest.raises(ValueError, match="2 values"):
        grading.sentence("{}", F.lit(1), F.lit(2))


def test_text_predicates(spark):
    names = [("Prod_x",), ("nonprod",), ("dev",), (None,)]
    frame = spark.createDataFrame(names, "c string")
    column = F.col("c")

    def kept(condition):
        return [r["c"] for r in frame.where(condition).collect()]

    assert kept(any_like(column, ["prod%"])) == ["Prod_x"]
    # The underscore is a wildcard.
    assert kept(any_like(column, ["%_prod"])) == ["nonprod"]
    assert kept(any_like(column, ["DEV"], negate=True)) == ["Prod_x", "nonprod"]
    assert len(kept(any_like(column, []))) == 4
    assert kept(any_like(column, [], negate=True)) == []
    assert kept(has_any(F.lower(column), ["od_", "ev"])) == ["Prod_x", "dev"]
    # Quotes in patterns are data.
    assert kept(any_like(column, ["it's%"])) == []


def test_blank_and_empty_values(spark):
    frame = spark.createDataFrame(
        [("a", [], {"k": "v"}), (" ", ["x"], {}), (None, None, None)],
        "t string, a array<string>, m map<string,string>",
    )
    got = frame.select(
        F.coalesce(non_blank(F.col("t")), F.lit(False)),
        filled_json(F.col("a")),
        filled_json(F.col("m")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, False, True),
        (False, True, False),
        (False, False, False),
    ]
