"""Grading and wording as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from posture.fixed_values import COMPLETED, IN_PROGRESS, MANUAL, OPEN, STATUS_RANK


def ratio_status(part: Column, whole: Column, complete_at: float) -> Column:
    """Nothing to measure is open; a share at or above the bar is completed."""
    nothing = (F.coalesce(whole, F.lit(0)) == 0) | part.isNull()
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return (
        F.when(nothing, OPEN).when(share >= complete_at, COMPLETED).otherwise(IN_PROGRESS)
    )


def presence_status(found: Column, expected: int = 1) -> Column:
    return (
        F.when(F.coalesce(found, F.lit(0)) == 0, OPEN)
        .when(found >= expected, COMPLETED)
        .otherwise(IN_PROGRESS)
    )


def signal_count(*signals: Column) -> Column:
    return reduce(add, (F.coalesce(s > 0, F.lit(False)).cast("int") for s in signals))


def signal_status(*signals: Column) -> Column:
    """None of the signals is open, one in progress, two or more completed."""
    n = signal_count(*signals)
    return F.when(n == 0, OPEN).when(n == 1, IN_PROGRESS).otherwise(COMPLETED)


def downgrade(status: Column, when: Column) -> Column:
    """Completed becomes in-progress where the control is unused or split."""
    return F.when((status == COMPLETED) & when, IN_PROGRESS).otherwise(status)


def status_rank(status: Column) -> Column:
    """Position of a status in reports, most actionable first."""
    return (
        F.when(status == OPEN, STATUS_RANK[OPEN])
        .when(status == IN_PROGRESS, STATUS_RANK[IN_PROGRESS])
        .when(status == MANUAL, STATUS_RANK[MANUAL])
        .when(status == COMPLETED, STATUS_RANK[COMPLETED])
        .otherwise(9)
    )


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def percent_text(share: Column) -> Column:
    """A 0-1 share as text with one decimal, ``n/a`` when there is none."""
    return F.when(share.isNull(), "n/a").otherwise(F.format_string("%.1f%%", share * 100))


def whole(column: Column) -> Column:
    """A count with thousands separators."""
    return F.format_number(column, 0)


def decimal(column: Column) -> Column:
    return F.format_string("%,.1f", F.coalesce(column.cast("double"), F.lit(0.0)))


def known(column: Column) -> Column:
    """A count that may be NULL, in words."""
    return F.coalesce(whole(column), F.lit("unknown"))


def sentence(template: str, *values: Column) -> Column:
    """Fill the ``{}`` marks of a text with (non-NULL) values in order."""
    if template.count("{}") != len(values):
        raise ValueError(f"{len(values)} values for: {template}")
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *values)


def listing(pairs: Column) -> Column:
    """An array of ``(key, n)`` as ``key=n, key=n``."""
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), whole(p["n"]))), ", "
    )


def rounded(column: Column) -> Column:
    """Half-to-even rounding to a whole number."""
    return F.bround(column, 0).cast("long")


def billed(total: Column) -> Column:
    """A usage total as a denominator: rounded, and 0 unless it is positive."""
    return F.when(total > 0, rounded(total)).otherwise(0)
