"""Text predicates as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_like(column: Column, patterns: Iterable[str], negate: bool = False) -> Column:
    """Case-insensitive LIKE against any pattern.

    Without patterns the plain form keeps every row and the negated form keeps none.
    """
    patterns = tuple(patterns)
    if not patterns:
        return F.lit(not negate)
    lowered = F.lower(column)
    hit = reduce(or_, (lowered.like(p.lower()) for p in patterns))
    return ~hit if negate else hit


def like(column: Column, pattern: str) -> Column:
    """LIKE on text that is lowercase already.

    A pattern with inner wildcards runs as a regular expression, so its longest
    literal piece is looked for first and few rows get that far.
    """
    pieces = re.split("[%_]+", pattern)
    if len(pieces) == 3 and pattern == f"%{pieces[1]}%":
        return column.contains(pieces[1])
    return column.contains(max(pieces, key=len)) & column.like(pattern)


def like_any(column: Column, patterns: Iterable[str]) -> Column:
    return reduce(or_, (like(column, p) for p in patterns))


def matches(column: Column, regex: str, *words: str) -> Column:
    """A regular expression, tried only on rows with one of the words it needs."""
    return has_any(column, words) & column.rlike(regex)


def has_any(column: Column, words: Iterable[str]) -> Column:
    """Whether the (already lowercased) text holds one of the plain words.

    Same answer as an alternation of literals, without the regex engine.
    """
    return reduce(or_, (column.contains(w) for w in words))


def named(column: Column, patterns: Iterable[str]) -> Column:
    """Case-sensitive LIKE against any pattern; no pattern matches nothing."""
    return reduce(or_, (column.like(p) for p in patterns), F.lit(False))


def non_blank(column: Column) -> Column:
    return column.isNotNull() & (F.trim(column) != "")


def lowered(column: Column) -> Column:
    """Lowercase with NULL read as the empty text."""
    return F.lower(F.coalesce(column, F.lit("")))


def filled_json(column: Column) -> Column:
    """Whether a nested column of unknown shape holds anything."""
    return column.isNotNull() & ~F.lower(F.to_json(column)).isin("null", "{}", "[]")
