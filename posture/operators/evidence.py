"""Fused aggregation: many measurements of one source in one pass.

A ``Pass`` lists measurements over one frame. They are answered together:

* without grouping, by one global aggregate;
* with a ``carrier`` (the column whose distinct values are asked for), by an
  aggregate per carrier value followed by a global one. The first step combines
  on the map side, so a value holding a large part of the rows costs one row per
  task in the shuffle, and any number of distinct counts over the carrier needs
  no row expansion;
* with ``spread`` keys (further distinct counts and mixes), by adding one row per key that
  is present, in the same scan and the same shuffle. These rows carry no carrier value, so
  a key costs one row per task, however many carrier values it meets;
* with ``keys`` (columns whose values are counted), by grouping on them as well. Only the
  grouped rows, few whatever the input, are then spread out: to one row per carrier value
  and one per mix and key, which are summed again. A mix keeps its most frequent keys,
  ranked before they meet (WindowGroupLimit), so counts and mixes come from one scan.
  Counted keys multiply with the carrier's values: where these are many, spread the key.

The outcome is long evidence: ``(metric, value, mix)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE = "metric string, value double, mix array<struct<key:string,n:bigint>>"
#: Stands for a NULL key in a mix, which may become the key of a map.
UNKNOWN = "unknown"
#: Keys of an unlimited mix that are listed in a rationale.
LISTED = 50
#: Days that are noted in one whole number.
BITS = 63
MIX = "array<struct<key:string,n:bigint>>"


@dataclass(frozen=True)
class Rows:
    """Number of rows (where the condition holds)."""

    where: Column | None = None


@dataclass(frozen=True)
class Total:
    """Sum of an expression."""

    of: Column


@dataclass(frozen=True)
class Mean:
    """Average of an expression over the rows where it is not NULL."""

    of: Column


@dataclass(frozen=True)
class Lowest:
    of: Column


@dataclass(frozen=True)
class Highest:
    of: Column


@dataclass(frozen=True)
class Distinct:
    """Distinct non-NULL values of a carrier, spread, counted key or (ungrouped) any column."""

    key: str
    where: Column | None = None


@dataclass(frozen=True)
class Groups:
    """Carrier groups that hold a matching row."""

    where: Column | None = None


@dataclass(frozen=True)
class GroupTest:
    """Carrier groups whose own row count (of ``where``) passes a test.

    Only groups with a row matching ``among`` are looked at.
    """

    where: Column | None
    test: Callable[[Column], Column]
    among: Column | None = None


@dataclass(frozen=True)
class Days:
    """Distinct days of a date that lies ``0 .. span`` days after ``first``.

    Days are bits of a few whole numbers, so no rows are grouped by day.
    """

    of: Column
    first: date
    span: int

    @property
    def words(self) -> int:
        return self.span // BITS + 1


@dataclass(frozen=True)
class Top:
    """The k most frequent values of a counted or spread key, ties in key order (None: all).

    NULL is a value of a counted key, and none of a spread one.
    """

    key: str
    k: int | None
    where: Column | None = None


Metric = Rows | Total | Mean | Lowest | Highest | Distinct | Groups | GroupTest | Days | Top


@dataclass(frozen=True)
class Pass:
    frame: DataFrame
    metrics: Mapping[str, Metric]
    #: Columns that several arguments share, or that cost much a row.
    features: Mapping[str, Column] = field(default_factory=dict)
    carrier: tuple[str, ...] = ()
    spread: Mapping[str, Column] = field(default_factory=dict)
    #: Columns whose values are counted; every element of an array counts.
    keys: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class TopK:
    """The k most frequent values of a key, ties in key order."""

    frame: DataFrame
    key: Column
    k: int | None


def _yes(where: Column | None) -> Column:
    return F.lit(True) if where is None else F.coalesce(where, F.lit(False))


def _count(where: Column | None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def _resolves(frame: DataFrame, column: Column) -> bool:
    try:
        frame.select(column)
    except AnalysisException:
        return False
    return True


def top_k(request: TopK) -> DataFrame:
    """``(key, n)`` rows, most frequent first."""
    counted = request.frame.groupBy(request.key.alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = counted.orderBy(F.desc("n"), F.asc("key"))
    return ordered if request.k is None else ordered.limit(request.k)


def measure(plan: Pass, wanted: Iterable[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Long evidence for the wanted metrics, and the metrics that do not resolve.

    A metric over a column the source lacks is reported and left out; the others
    are measured.
    """
    frame = _featured(plan)
    wanted = [n for n in wanted if n in plan.metrics]
    try:
        return _evidence(frame, plan, wanted), {}
    except AnalysisException:
        failed = {}
        for name in list(wanted):
            try:
                _evidence(frame, plan, [name])
            except AnalysisException as problem:
                failed[name] = " ".join(str(problem).split("\n"))[:600]
                wanted.remove(name)
        return (_evidence(frame, plan, wanted) if wanted else None), failed


def mix_rows(plan: Pass, name: str) -> DataFrame:
    """The ``(key, n)`` rows of one mix, most frequent first; NULL keys as they are."""
    top = plan.metrics[name]
    grouped = _Grouped(plan, {name: top}, unknown=None)
    rows = grouped.rows(_featured(plan))
    counted = grouped.by_key(rows) if grouped.keys else rows
    ordered = (
        counted.where(F.col("_kind") == _mix_kind(name))
        .select(F.col("_key").alias("key"), F.col("_n").alias("n"))
        .orderBy(F.desc("n"), F.asc("key"))
    )
    return ordered if top.k is None else ordered.limit(top.k)


def columns_read(plan: Pass, metrics: Iterable[str]) -> dict[str, frozenset[str]]:
    """The columns of the pass's frame that each metric reads, its keys included."""
    frame = _featured(plan)
    behind = {
        name: _references(plan.frame.select(column))
        for name, column in plan.features.items()
        if name in frame.columns
    }
    found = {}
    for name in metrics:
        grouped = _Grouped(plan, {name: plan.metrics[name]})
        if grouped.levels:
            read = _references(grouped.arguments(frame))
        else:
            read = _references(frame.agg(_global(plan.metrics[name]).alias("value")))
        found[name] = frozenset().union(*(behind.get(c, {c}) for c in read))
    return found


def _references(frame: DataFrame) -> set[str]:
    """Columns that the last step of a plan reads from the one below."""
    attributes = frame._jdf.queryExecution().analyzed().references().toSeq()
    return {attributes.apply(i).name() for i in range(attributes.size())}


def _featured(plan: Pass) -> DataFrame:
    usable = {n: c for n, c in plan.features.items() if _resolves(plan.frame, c)}
    return plan.frame.withColumns(usable) if usable else plan.frame


def _evidence(frame: DataFrame, plan: Pass, wanted: list[str]) -> DataFrame:
    metrics = {name: plan.metrics[name] for name in wanted}
    grouped = _Grouped(plan, metrics)
    if grouped.levels:
        row = grouped.row(frame)
    else:
        row = frame.agg(*(_global(m).alias(n) for n, m in metrics.items()))
    entries = ", ".join(
        f"named_struct('metric', '{n}', 'value', CAST(NULL AS DOUBLE), 'mix', `{n}`)"
        if isinstance(m, Top)
        else f"named_struct('metric', '{n}', 'value', CAST(`{n}` AS DOUBLE),"
        f" 'mix', CAST(NULL AS {MIX}))"
        for n, m in metrics.items()
    )
    return row.selectExpr(f"inline(array({entries}))")


def _days_in(word: Column | None, at: Column, number: int) -> Column:
    """The days of one whole number as bits."""
    mine = F.floor(at / BITS) == number
    one = F.lit(1).cast("bigint")
    bit = F.call_function("shiftleft", one, F.pmod(at, F.lit(BITS)).cast("int"))
    return F.bit_or(F.when(mine if word is None else word & mine, bit))


def _day_number(metric: Days) -> Column:
    return F.date_diff(metric.of, F.lit(metric.first))


def _bits(words: Iterable[Column]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.coalesce(F.bit_count(word), F.lit(0))
    return total


def _global(metric: Metric) -> Column:
    match metric:
        case Rows(where):
            return _count(where)
        case Total(of):
            return F.sum(of)
        case Mean(of):
            return F.avg(of)
        case Lowest(of):
            return F.min(of)
        case Highest(of):
            return F.max(of)
        case Distinct(key, where):
            return F.count_distinct(F.when(_yes(where), F.col(key)))
        case Days():
            at = _day_number(metric)
            return _bits(_days_in(None, at, i) for i in range(metric.words))
    raise TypeError(f"{type(metric).__name__} needs a carrier")


def _mix_kind(name: str) -> str:
    return f"#{name}"


def _value_kind(name: str) -> str:
    return f"={name}"


class _Grouped:
    """The grouped plan of some metrics of a pass.

    ``slots`` names the partial results of a metric; ``partials`` holds each with its first
    aggregate (over rows) and the one that merges it (over groups).
    """

    def __init__(
        self, plan: Pass, metrics: Mapping[str, Metric], unknown: str | None = UNKNOWN
    ):
        used = {m.key for m in metrics.values() if isinstance(m, Distinct | Top)}
        self.plan, self.metrics, self.unknown = plan, metrics, unknown
        self.carrier = plan.carrier
        self.spread = {k: c for k, c in plan.spread.items() if k in used}
        self.keys = {k: c for k, c in plan.keys.items() if k in used}
        self.slots = {name: f"m{i}" for i, name in enumerate(metrics)}
        self.levels = bool(self.carrier or self.spread or self.keys)

    def row(self, frame: DataFrame) -> DataFrame:
        """One row with a column per metric."""
        rows = self.rows(frame)
        if self.keys:
            rows = self.by_key(rows)
        rows = self._ranked(rows)
        return rows.agg(*(self._overall(n, m).alias(n) for n, m in self.metrics.items()))

    def rows(self, frame: DataFrame) -> DataFrame:
        """One row per value of carrier, counted keys and spread keys."""
        narrow = self._narrow(frame)
        by = [F.col(c) for c in self.carrier] + [F.col(f"_mix_{k}") for k in self.keys]
        if self.spread:
            by += [F.col("_kind"), F.col("_key")]
        first = [column.alias(s) for s, column, _ in self._partials()]
        if self._spread_tops():
            first.append(F.count(F.lit(1)).alias("_n"))
        if not first:  # a lone distinct count of a carrier's values needs no partial result
            first = [F.count(F.lit(1)).alias("_rows")]
        return narrow.groupBy(*by).agg(*first)

    def _spread_tops(self, key: str | None = None) -> list[str]:
        return [
            n
            for n, m in self.metrics.items()
            if isinstance(m, Top) and m.key in self.spread and key in (None, m.key)
        ]

    def _partials(self) -> list[tuple[str, Column, Callable[[str], Column]]]:
        own = F.col("_kind") == "" if self.spread else F.lit(True)
        found: list[tuple[str, Column, Callable[[str], Column]]] = []
        for name, metric in self.metrics.items():
            s = self.slots[name]
            arg = F.col(s)
            match metric:
                case Top(key) if key in self.spread:
                    pass  # its rows are of a kind of their own, and counted together
                case Rows(None):
                    found.append((s, F.count_if(own), F.sum))
                case Rows() | Top():
                    found.append((s, F.count_if(own & arg), F.sum))
                case Total():
                    found.append((s, F.sum(F.when(own, arg)), F.sum))
                case Mean():
                    found.append((s, F.sum(F.when(own, arg).cast("double")), F.sum))
                    found.append((f"{s}_n", F.count(F.when(own, arg)), F.sum))
                case Lowest():
                    found.append((s, F.min(F.when(own, arg)), F.min))
                case Highest():
                    found.append((s, F.max(F.when(own, arg)), F.max))
                case Groups():
                    found.append((s, F.max(F.coalesce(own & arg, F.lit(False))), F.max))
                case GroupTest():
                    found.append((s, F.count_if(own & arg), F.sum))
                    found.append((f"{s}_in", F.max(own & F.col(f"{s}_in")), F.max))
                case Distinct(key, _):
                    mine = F.col("_kind") == key if key in self.spread else own
                    found.append((s, F.max(F.coalesce(mine & arg, F.lit(False))), F.max))
                case Days():
                    found += [
                        (f"{s}_{i}", _days_in(own, arg, i), F.bit_or)
                        for i in range(metric.words)
                    ]
        return found

    def by_key(self, rows: DataFrame) -> DataFrame:
        """One row per carrier value (kind ''), spread key, and counted key of each metric.

        Partial results stay with the rows of carriers and spread keys; ``_n`` counts a key.
        """
        entry = "array<struct<kind:string,key:string,n:bigint>>"
        if self.spread:
            kind, key = F.col("_kind"), F.col("_key")
        else:
            kind, key = F.lit(""), F.lit(None).cast("string")
        n = F.col("_n") if self._spread_tops() else F.lit(0)
        entries = [F.array(_entry(kind, key, n))]
        kinds = dict(rows.dtypes)
        for name, metric in self.metrics.items():
            if not (isinstance(metric, Distinct | Top) and metric.key in self.keys):
                continue
            s, value = F.col(self.slots[name]), F.col(f"_mix_{metric.key}")
            values = value if kinds[f"_mix_{metric.key}"].startswith("array") else F.array(value)
            if isinstance(metric, Top):
                held, n, kind = s > 0, s, _mix_kind(name)
            else:
                held, n, kind = s, F.lit(1), _value_kind(name)
                values = F.filter(values, lambda v: v.isNotNull())
            listed = _listed(values, F.lit(kind), n)
            # A NULL array lists nothing, and must not take the row with it.
            entries.append(F.coalesce(F.when(held, listed), F.array().cast(entry)))
        flat = F.flatten(F.array(*(e.cast(entry) for e in entries)))
        spread_out = rows.withColumn("_entry", F.explode(flat))
        base = ~F.substring("_entry.kind", 1, 1).isin("#", "=")
        partials = self._partials()
        return (
            spread_out.select(
                *(F.when(base, F.col(c)).alias(c) for c in self.carrier),
                *(F.when(base, F.col(s)).alias(s) for s, _, _ in partials),
                F.col("_entry.kind").alias("_kind"),
                F.col("_entry.key").alias("_key"),
                F.col("_entry.n").alias("_n"),
            )
            .groupBy(*self.carrier, "_kind", "_key")
            .agg(*(merge(s).alias(s) for s, _, merge in partials), F.sum("_n").alias("_n"))
        )

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """Of each mix the rows that may be listed; all other rows stay."""
        tops = [m for m in self.metrics.values() if isinstance(m, Top)]
        if not tops:
            return rows
        most = max(LISTED if m.k is None else m.k for m in tops)
        in_mix = F.substring("_kind", 1, 1) == "#"
        # Every row that belongs to no mix is a part of its own.
        part = Window.partitionBy("_kind", *self.carrier, F.when(~in_mix, F.col("_key")))
        rank = F.row_number().over(part.orderBy(F.desc("_n"), F.asc("_key")))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= most)

    def _overall(self, name: str, metric: Metric) -> Column:
        s = self.slots[name]
        present = F.lit(True)
        for c in self.carrier:
            present = present & F.col(c).isNotNull()
        match metric:
            case Rows() | Total():
                return F.sum(s)
            case Mean():
                return F.try_divide(F.sum(s), F.sum(f"{s}_n"))
            case Lowest():
                return F.min(s)
            case Highest():
                return F.max(s)
            case Groups():
                return F.count_if(F.col(s) & present)
            case GroupTest(_, test, _):
                return F.count_if(F.col(f"{s}_in") & test(F.col(s)))
            case Days():
                return _bits(F.bit_or(f"{s}_{i}") for i in range(metric.words))
            case Top():
                k = LISTED if metric.k is None else metric.k
                mine = (F.col("_kind") == _mix_kind(name)) & (F.col("_rank") <= k)
                pair = F.struct((-F.col("_n")).alias("n"), F.col("_key").alias("key"))
                return F.transform(
                    F.sort_array(F.collect_list(F.when(mine, pair))),
                    lambda p: F.struct(p["key"].alias("key"), (-p["n"]).alias("n")),
                ).cast(MIX)
        key = metric.key
        if key in self.keys:
            return F.count_if(F.col("_kind") == _value_kind(name))
        if key in self.spread:
            return F.count_if(F.col(s))
        if self.carrier == (key,):
            return F.count_if(F.col(s) & present)
        return F.count_distinct(F.when(F.col(s), F.col(key)))

    def arguments(self, frame: DataFrame) -> DataFrame:
        """Only keys and metric arguments, so wide text never reaches the aggregate."""
        values = [c.cast("string").alias(f"_key_{k}") for k, c in self.spread.items()]
        return frame.select(*(c.alias(n) for n, c in self._arguments(frame).items()), *values)

    def _arguments(self, frame: DataFrame) -> dict[str, Column]:
        columns = {c: F.col(c) for c in self.carrier}
        for key, column in self.keys.items():
            columns[f"_mix_{key}"] = self._counted(frame, column)
        for name, metric in self.metrics.items():
            s = self.slots[name]
            match metric:
                case Rows(None):
                    pass
                case Rows(where) | Groups(where) | Top(_, _, where) | Distinct(_, where):
                    columns[s] = _yes(where)
                case GroupTest(where, _, among):
                    columns |= {s: _yes(where), f"{s}_in": _yes(among)}
                case Total(of) | Mean(of) | Lowest(of) | Highest(of):
                    columns[s] = of
                case Days():
                    columns[s] = _day_number(metric)
        return columns

    def _narrow(self, frame: DataFrame) -> DataFrame:
        """Arguments, and one further row per spread key that is present.

        Arguments are computed before rows are spread, or, where features hold the costly
        part of them, after: each half is then a generated method of its own. One method
        over 8,000 bytes of code is never compiled by the JVM, but interpreted.
        """
        if not self.spread:
            return self.arguments(frame)
        early = not self.plan.features
        if early:
            frame = self.arguments(frame)
        entries = [F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("key"))]
        for key, column in self.spread.items():
            value = F.col(f"_key_{key}") if early else column.cast("string")
            entries += [
                F.when(
                    value.isNotNull() & used,
                    F.struct(F.lit(kind).alias("kind"), value.alias("key")),
                )
                for kind, used in self._kinds(key, early).items()
            ]
        # Plain explode and filter stay inside generated code; absent keys never leave it.
        widened = frame.withColumn("_entry", F.explode(F.array(*entries))).where(
            F.col("_entry").isNotNull()
        )
        if early:
            arguments = {c: F.col(c) for c in frame.columns if not c.startswith("_key_")}
        else:
            arguments = self._arguments(widened)
        grouped = {*self.carrier, *(f"_mix_{k}" for k in self.keys)}
        base = F.col("_entry.kind") == ""
        return widened.select(
            *((F.when(base, c) if n in grouped else c).alias(n) for n, c in arguments.items()),
            F.col("_entry.kind").alias("_kind"),
            F.col("_entry.key").alias("_key"),
        )

    def _kinds(self, key: str, early: bool) -> dict[str, Column]:
        """The kinds of rows that a spread key adds, and when."""

        def used(name: str) -> Column:
            return F.col(self.slots[name]) if early else _yes(self.metrics[name].where)

        flags = [
            used(n) for n, m in self.metrics.items() if isinstance(m, Distinct) and m.key == key
        ]
        kinds = {key: reduce(or_, flags)} if flags else {}
        return kinds | {_mix_kind(n): used(n) for n in self._spread_tops(key)}

    def _counted(self, frame: DataFrame, column: Column) -> Column:
        """A counted key as it is grouped by; arrays in one order, so fewer differ."""
        if frame.select(column).dtypes[0][1].startswith("array"):
            return F.array_sort(column)
        if self.unknown is None:
            return column
        return F.coalesce(column.cast("string"), F.lit(self.unknown))


def _listed(values: Column, kind: Column, n: Column) -> Column:
    return F.transform(values, lambda v: _entry(kind, v.cast("string"), n))


def _entry(kind: Column, key: Column, n: Column) -> Column:
    return F.struct(
        kind.alias("kind"), key.alias("key"), n.cast("bigint").alias("n")
    )
