"""Logical telemetry sources and whether they can be read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.fixed_values import REQUIRED_SOURCES
from posture.sources.schemas import SCHEMAS

Loader = Callable[[SparkSession], DataFrame]


class Sources:
    """Maps logical names (``schema.table``) to DataFrames.

    A relation is a DataFrame, a function of the session, or a table name. Reading
    is lazy; a source counts as readable when its relation resolves and, unless
    ``probe_rows`` is off, one row of it can be read, which also finds missing
    grants on the files behind a table.
    """

    def __init__(
        self,
        spark: SparkSession,
        relations: Mapping[str, DataFrame | Loader | str],
        probe_rows: bool = True,
    ):
        self.spark = spark
        self._relations = dict(relations)
        self._probe_rows = probe_rows
        self._frames: dict[str, DataFrame | None] = {}
        self.problems: dict[str, str] = {}

    @classmethod
    def from_tables(cls, spark: SparkSession, prefix: str = "", **options) -> Sources:
        """Every known source as a catalog table ``<prefix><schema>.<table>``."""
        return cls(spark, {name: f"{prefix}{name}" for name in SCHEMAS}, **options)

    @classmethod
    def from_directory(
        cls, spark: SparkSession, root: str, fmt: str = "parquet", **options
    ) -> Sources:
        """Every known source as a directory ``<root>/<schema>/<table>``."""

        def load(path: str) -> Loader:
            return lambda session: session.read.format(fmt).load(path)

        paths = {n: f"{root.rstrip('/')}/{n.replace('.', '/')}" for n in SCHEMAS}
        return cls(spark, {n: load(p) for n, p in paths.items()}, **options)

    @classmethod
    def empty(cls, spark: SparkSession) -> Sources:
        """Every known source readable and without rows."""
        frames = {n: spark.createDataFrame([], ddl) for n, ddl in SCHEMAS.items()}
        return cls(spark, frames, probe_rows=False)

    def _resolve(self, name: str) -> DataFrame | None:
        if name not in self._frames:
            relation = self._relations.get(name)
            frame = None
            try:
                if isinstance(relation, str):
                    frame = self.spark.table(relation)
                elif callable(relation):
                    frame = relation(self.spark)
                else:
                    frame = relation
                if frame is None:
                    self.problems[name] = "not registered"
                else:
                    frame.schema  # noqa: B018 - resolves the relation
                    if self._probe_rows:
                        frame.limit(1).collect()
            except Exception as problem:  # also what is no Spark error, as a lost file
                self.problems[name] = _first_line(problem)
                frame = None
            self._frames[name] = frame
        return self._frames[name]

    def readable(self, name: str) -> bool:
        return self._resolve(name) is not None

    def frame(self, name: str) -> DataFrame:
        frame = self._resolve(name)
        if frame is None:
            raise LookupError(f"{name} is not readable: {self.problems[name]}")
        return frame

    def has_column(self, name: str, column: str) -> bool:
        return self.readable(name) and column in self.frame(name).columns

    def availability(self, names: Iterable[str] = tuple(SCHEMAS)) -> DataFrame:
        """``(position, source, readable, problem)``, one row per source."""
        rows = [
            (i, n, self.readable(n), self.problems.get(n)) for i, n in enumerate(names)
        ]
        return self.spark.createDataFrame(
            rows, "position int, source string, readable boolean, problem string"
        )

    def first_unreadable(self, names: Iterable[str]) -> DataFrame:
        """The first of the needed sources that cannot be read (no row: all can)."""
        return (
            self.availability(names)
            .where(~F.col("readable"))
            .agg(F.min_by("source", "position").alias("source"))
            .where(F.col("source").isNotNull())
        )

    def census(self, names: Iterable[str] = tuple(SCHEMAS)) -> DataFrame:
        """``(source, readable, n)``: the rows of each source, NULL where it cannot be read."""
        kind = "source string, readable boolean, n bigint"
        lost = [(n, False, None) for n in names if not self.readable(n)]
        counted = self.spark.createDataFrame(lost, kind)
        for name in names:
            if self.readable(name):
                n = self.frame(name).agg(F.count(F.lit(1)).alias("n"))
                row = n.select(F.lit(name).alias("source"), F.lit(True).alias("readable"), "n")
                counted = counted.unionByName(row)
        return counted

    def readiness(self) -> DataFrame:
        """The required sources with their purpose and whether they can be read."""
        needed = self.spark.createDataFrame(
            [(i, s, p) for i, (s, p) in enumerate(REQUIRED_SOURCES)],
            "ordinal int, source string, purpose string",
        )
        state = self.availability().select("source", "readable")
        return (
            needed.join(state, "source", "left")
            .select(
                "ordinal",
                "source",
                "purpose",
                F.coalesce("readable", F.lit(False)).alias("readable"),
            )
            .orderBy("ordinal")
        )


def _first_line(problem: Exception, limit: int = 600) -> str:
    text = f"{type(problem).__name__}: {problem}"
    return " ".join(text.split("\n"))[:limit]
