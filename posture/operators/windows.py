"""Activity windows that reach the scan as pushed filters."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posture.config import AssessmentConfig


def _bound(frame: DataFrame, column: str, at: datetime) -> Column:
    """An instant as a literal of the column's own type.

    So no cast hides the column from Parquet row-group and partition pruning.
    """
    at = at.astimezone(UTC)
    kind = frame.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.lit(at.date())
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(at.isoformat()).cast("timestamp")


def since(
    frame: DataFrame, column: str, config: AssessmentConfig, days: int | None = None
) -> Column:
    """``column`` lies in the last ``days`` (default: the lookback) before ``as_of``.

    Both ends are included; what happened after ``as_of`` is not counted.
    """
    start = _bound(frame, column, config.window_start(days))
    return (F.col(column) >= start) & (F.col(column) <= _bound(frame, column, config.as_of))


def known(frame: DataFrame, column: str, config: AssessmentConfig) -> Column:
    """A version that existed at ``as_of`` (or carries no time)."""
    at = F.col(column)
    return at.isNull() | (at <= _bound(frame, column, config.as_of))


def alive(frame: DataFrame, column: str, config: AssessmentConfig) -> Column:
    """Not deleted, or deleted after ``as_of``."""
    at = F.col(column)
    return at.isNull() | (at > _bound(frame, column, config.as_of))


def in_window(
    frame: DataFrame, column: str, config: AssessmentConfig, days: int | None = None
) -> DataFrame:
    return frame.where(since(frame, column, config, days))
