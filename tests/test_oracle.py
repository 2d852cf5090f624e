"""Every registered query against its SQL counterpart on another engine."""

import math

import duckdb
import pytest

import __spark_entry__ as registered
from conftest import SF_DIR
from oracle.questions import question_sql
from posture.config import AssessmentConfig
from posture.operators.run import Run
from posture.plans.scorecard import answer
from posture.sources.star_telemetry import AS_OF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'"
        )
    yield connection
    connection.close()


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(comparable(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(found, key=repr)


def own_queries():
    """The queries that do not come from the optional folder of training-data operators."""
    found = registered.queries()
    extra = registered.training_data.QUERIES if registered.training_data else {}
    return {n: q for n, q in found.items() if n not in extra and n != "pipeline"}


def test_every_query_has_a_counterpart():
    assert own_queries().keys() <= registered.oracle_sql().keys()


@pytest.mark.parametrize("name", list(own_queries()))
def test_query_matches(spark, engine, name):
    frame = registered.queries()[name](spark, SF_DIR)
    ours = as_rows(frame.columns, [tuple(r) for r in frame.collect()])
    answer = engine.execute(registered.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    theirs = as_rows(names, answer.fetchall())
    assert ours == theirs
    kinds = {n: type(v) for r in theirs[1] for n, v in zip(theirs[0], r, strict=True)}
    mine = {n: type(v) for r in ours[1] for n, v in zip(ours[0], r, strict=True)}
    assert kinds == mine


@pytest.mark.parametrize(
    "question_id",
    ["IU-03-02", "OE-04-02", "CO-03-03", "CO-01-02", "R-01-02", "CO-02-01", "DG-02-02", "OE-01-08"],
)
def test_shorter_lookback(star_run, engine, question_id):
    """A window shorter than the trend periods, over the same scan."""
    config = AssessmentConfig(as_of=AS_OF, lookback_days=30)
    found = answer(Run(star_run.sources, config), question_id)
    ours = as_rows(found.columns, [tuple(r) for r in found.collect()])
    sql = question_sql(question_id).replace("2023-11-02", "2024-01-01")
    sql = sql.replace("CAST(90 AS BIGINT)", "CAST(30 AS BIGINT)")
    reply = engine.execute(sql)
    names = [d[0] for d in reply.description]
    assert ours == as_rows(names, reply.fetchall())
