"""Which catalogs and schemas count as production."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posture.config import AssessmentConfig
from posture.functions.text import any_like

IN_SCOPE = "in_scope"
PRODUCTION, EVERYTHING = "prod", "all"
#: Catalog names in the label of a scope.
LABELLED = 8
CAVEAT = (
    "[SCOPE: no catalog matched the production patterns; every non-system catalog was"
    " assessed] "
)


def candidate_catalogs(catalogs: DataFrame, config: AssessmentConfig) -> DataFrame:
    """Non-system catalogs with a flag for the production patterns."""
    name = F.col("catalog_name")
    if config.production_patterns:
        production = F.coalesce(any_like(name, config.production_patterns), F.lit(False))
    else:
        production = F.lit(False)
    return catalogs.where(any_like(name, config.system_catalogs, negate=True)).select(
        "catalog_name", production.alias("production")
    )


def scope_frame(catalogs: DataFrame, config: AssessmentConfig) -> DataFrame:
    """``(catalog_name, mode)``: production catalogs, or all when none matches.

    Whether any matches is one row, found by a partial aggregate and joined back on the
    flag it is compared with, so names stay in their partitions.
    """
    names = candidate_catalogs(catalogs, config)
    hit = names.agg(F.max("production").alias("hit"))
    mode = F.when(F.col("hit"), PRODUCTION).otherwise(EVERYTHING)
    return names.join(hit, F.col("production") == F.col("hit")).select(
        "catalog_name", mode.alias("mode")
    )


@dataclass(frozen=True)
class Scope:
    mode: str
    size: int
    first_names: tuple[str, ...]
    frame: DataFrame
    excluded_schemas: tuple[str, ...]

    @property
    def label(self) -> str:
        if self.mode == PRODUCTION:
            return f"production ({self.size} catalog(s): {', '.join(self.first_names)})"
        return f"all non-system catalogs ({self.size})"

    @property
    def caveat(self) -> str:
        return "" if self.mode == PRODUCTION else CAVEAT

    def schemas(self, column: str) -> Column:
        """``column`` names a schema that is neither excluded nor the metadata schema."""
        real = F.lower(F.col(column)) != "information_schema"
        if not self.excluded_schemas:
            return real
        return any_like(F.col(column), self.excluded_schemas, negate=True) & real

    def mark(self, frame: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
        """Add the flag ``in_scope``.

        The scope is joined without a hint, so Spark broadcasts it only if its measured
        size allows.
        """
        hits = self.frame.select(
            F.col("catalog_name").alias("_scope_catalog"), F.lit(True).alias("_scope_hit")
        ).distinct()
        frame = frame.join(hits, F.col(catalog) == F.col("_scope_catalog"), "left")
        inside = F.coalesce(F.col("_scope_hit"), F.lit(False))
        if schema is not None:
            inside = inside & self.schemas(schema)
        return frame.withColumn(IN_SCOPE, inside).drop("_scope_catalog", "_scope_hit")

    def restrict(self, frame: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
        """Only the rows in scope."""
        kept = frame if schema is None else frame.where(self.schemas(schema))
        hits = self.frame.select(F.col("catalog_name").alias("_scope_catalog"))
        return kept.join(hits, F.col(catalog) == F.col("_scope_catalog"), "left_semi")


def resolve_scope(catalogs: DataFrame, config: AssessmentConfig) -> Scope:
    """Mode and size, and a few names for the label; the names themselves stay in Spark."""
    frame = scope_frame(catalogs, config).persist()
    found = frame.agg(F.count(F.lit(1)).alias("n"), F.max("mode").alias("mode")).first()
    head = frame.orderBy("catalog_name").limit(LABELLED).collect()
    names = tuple(r["catalog_name"] for r in head)
    return Scope(found["mode"] or EVERYTHING, found["n"], names, frame, config.excluded_schemas)
