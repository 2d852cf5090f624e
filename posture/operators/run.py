"""Everything a measurement may ask of a run."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.config import AssessmentConfig
from posture.operators import windows
from posture.operators.scope import IN_SCOPE, Scope, resolve_scope
from posture.sources.registry import Sources

CATALOGS = "information_schema.catalogs"


class Run:
    def __init__(self, sources: Sources, config: AssessmentConfig):
        self.sources = sources
        self.config = config
        self.scope_problem: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.sources.spark

    @cached_property
    def scope(self) -> Scope | None:
        """The resolved scope; ``None`` when the catalogs cannot be read."""
        if not self.sources.readable(CATALOGS):
            self.scope_problem = f"{CATALOGS} is not readable"
            return None
        try:
            return resolve_scope(self.sources.frame(CATALOGS), self.config)
        except Exception as problem:  # also what is no Spark error, as a lost file
            self.scope_problem = " ".join(str(problem).split("\n"))[:600]
            return None

    def release(self) -> None:
        """Give back what the run keeps; frames that use the scope must be done."""
        if self.__dict__.get("scope") is not None:
            self.scope.frame.unpersist()

    def marked(self, frame: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
        """Rows with the flag ``in_scope``; without a scope nothing is inside."""
        if self.scope is None:
            return frame.withColumn(IN_SCOPE, F.lit(False))
        return self.scope.mark(frame, catalog, schema)

    def since(self, frame: DataFrame, column: str, days: int | None = None) -> Column:
        return windows.since(frame, column, self.config, days)

    def alive(self, frame: DataFrame, column: str) -> Column:
        return windows.alive(frame, column, self.config)

    def known(self, frame: DataFrame, column: str) -> Column:
        return windows.known(frame, column, self.config)

    def days(self) -> tuple[date, int]:
        """First day and number of further days that the lookback window can touch.

        A day more at either end leaves room for any session time zone.
        """
        first = self.config.window_start(None).date() - timedelta(days=1)
        return first, (self.config.as_of.date() - first).days + 1

    def recent(self, source: str, column: str, days: int | None = None) -> DataFrame:
        """The rows of a source inside its activity window."""
        return windows.in_window(self.sources.frame(source), column, self.config, days)
