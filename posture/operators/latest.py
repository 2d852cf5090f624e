"""Latest version of each entity in a change history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIE_BREAK = "version"
IS_NEWEST = "is_newest"


def _hashable(value: Column, kind: T.DataType) -> Column:
    """``value`` without maps, which have no hash of their own."""
    match kind:
        case T.MapType():
            entries = F.transform(
                F.map_entries(value),
                lambda e: F.struct(
                    e["key"].alias("key"), _hashable(e["value"], kind.valueType).alias("value")
                ),
            )
            return F.array_sort(entries)
        case T.ArrayType() if _holds_map(kind):
            return F.transform(value, lambda x: _hashable(x, kind.elementType))
        case T.StructType() if _holds_map(kind):
            return F.when(
                value.isNotNull(),
                F.struct(*(_hashable(value[f.name], f.dataType).alias(f.name) for f in kind)),
            )
    return value


def _holds_map(kind: T.DataType) -> bool:
    match kind:
        case T.MapType():
            return True
        case T.ArrayType():
            return _holds_map(kind.elementType)
        case T.StructType():
            return any(_holds_map(f.dataType) for f in kind)
    return False


def _tie_break(history: DataFrame) -> Column:
    if TIE_BREAK in history.columns:
        return F.col(TIE_BREAK)
    return F.xxhash64(*(_hashable(F.col(f.name), f.dataType) for f in history.schema))


def newest_and_counts(
    history: DataFrame,
    key: str,
    changed_at: str,
    live: Column,
    counts: Mapping[str, Column],
    rank_before_live_filter: bool = False,
    among: Column | None = None,
) -> DataFrame:
    """One row per ``key`` over a single scan: its newest live version, and counts of all.

    The picks are those of :func:`latest`, taken by an aggregate that keeps one row per key
    and task before the shuffle. ``among`` limits the versions that can be picked, ``counts``
    looks at every one. Without a version to pick ``IS_NEWEST`` is false.
    """
    candidate = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    alive = F.coalesce(live, F.lit(False))
    if not rank_before_live_filter:
        candidate = candidate & alive
    row = F.struct(alive.alias(IS_NEWEST), *history.columns)
    place = F.struct(F.col(changed_at).alias("at"), _tie_break(history).alias("tie"))
    newest = F.max_by(F.when(candidate, row), F.when(candidate, place))
    grouped = history.groupBy(F.col(key).alias("_entity")).agg(
        newest.alias("_newest"), *(F.count_if(c).alias(n) for n, c in counts.items())
    )
    return grouped.select("_newest.*", *counts).withColumn(
        IS_NEWEST, F.coalesce(IS_NEWEST, F.lit(False))
    )


def latest(
    history: DataFrame,
    key: str,
    changed_at: str,
    live: Column,
    rank_before_live_filter: bool = False,
) -> DataFrame:
    """One row per ``key``: the newest live version.

    By default tombstones are dropped first, so a deleted entity counts with its
    last live version; ``rank_before_live_filter`` drops the entity instead.
    Equal change times fall back to the ``version`` column, or else to a hash of
    the row (maps go into it as arrays of entries, in key order), so the pick does not
    depend on how the data is partitioned. Spark
    keeps one row per key and map task before the shuffle (WindowGroupLimit), so a
    key with very many versions does not pile up in one task.
    """
    tie = _tie_break(history)
    newest_first = Window.partitionBy(key).orderBy(F.col(changed_at).desc(), tie.desc())
    candidates = history if rank_before_live_filter else history.where(live)
    newest = (
        candidates.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
    return newest.where(live) if rank_before_live_filter else newest
