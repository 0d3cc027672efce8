"""Predicates that are both a filter on rows and bounds on windows.

``field("ts") >= "2024-01-01"`` and the like, joined by ``&`` and ``|``. Any Column may stand in for a predicate; it
filters rows and bounds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WhereClauseError
from ..functions.timeparse import to_datetime
from .bounds import Bounds, from_comparison


class Predicate:
    def __and__(self, other: Predicate | Column) -> Predicate:
        return Both(self, wrap(other))

    def __or__(self, other: Predicate | Column) -> Predicate:
        return Either(self, wrap(other))

    def column(self, partition: str | None) -> Column:
        """The filter; ``partition`` names the column whose literals are points in time."""
        raise NotImplementedError

    def bounds(self, partition: str, interval: int) -> Bounds:
        return Bounds()


@dataclass(frozen=True)
class Plain(Predicate):
    """A Column as a predicate."""

    condition: Column

    def column(self, partition: str | None) -> Column:
        return self.condition


@dataclass(frozen=True)
class Both(Predicate):
    left: Predicate
    right: Predicate

    def column(self, partition):
        return self.left.column(partition) & self.right.column(partition)

    def bounds(self, partition, interval):
        return self.left.bounds(partition, interval).meet(self.right.bounds(partition, interval))


@dataclass(frozen=True)
class Either(Predicate):
    left: Predicate
    right: Predicate

    def column(self, partition):
        return self.left.column(partition) | self.right.column(partition)

    def bounds(self, partition, interval):
        return self.left.bounds(partition, interval).join(self.right.bounds(partition, interval))


#: Operators on a column and a literal.
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "is", "is not", "in", "between", "is null", "is not null", "like", "glob", "regexp")


@dataclass(frozen=True)
class Compare(Predicate):
    name: str
    op: str
    value: Any = None

    def literal(self, partition: str | None, value: Any):
        return F.lit(to_datetime(value)).cast("timestamp_ntz") if self.name == partition and value is not None else F.lit(value)

    def column(self, partition):
        col, value = F.col(self.name), self.value
        one = lambda: self.literal(partition, value)
        match self.op:
            case "=":
                return col == one()
            case "!=":
                return col != one()
            case ">":
                return col > one()
            case ">=":
                return col >= one()
            case "<":
                return col < one()
            case "<=":
                return col <= one()
            case "is":
                return col.eqNullSafe(one())
            case "is not":
                return ~col.eqNullSafe(one())
            case "in":
                return col.isin([self.literal(partition, v) for v in value]) if value else F.lit(False)
            case "between":
                return col.between(self.literal(partition, value[0]), self.literal(partition, value[1]))
            case "is null":
                return col.isNull()
            case "is not null":
                return col.isNotNull()
            case "like":
                return col.cast("string").ilike(value)
            case "glob":
                return col.cast("string").rlike(glob_pattern(value))
            case "regexp":
                return col.cast("string").rlike(value)
        raise WhereClauseError(f"unknown operator {self.op!r}; known are {', '.join(OPERATORS)}")

    def bounds(self, partition, interval):
        if self.name != partition:
            return Bounds()
        match self.op:
            case "=" | ">" | ">=" | "<" | "<=":
                return from_comparison(self.op, self.value, interval)
            case "is" if self.value is not None:
                return from_comparison("=", self.value, interval)
            case "in":
                out = Bounds.of()
                for value in self.value:
                    out = out.join(from_comparison("=", value, interval))
                return out
            case "between":
                return from_comparison(">=", self.value[0], interval).meet(from_comparison("<=", self.value[1], interval))
        return Bounds()


def glob_pattern(glob: str) -> str:
    """A regular expression for a case-sensitive glob: ``*``, ``?`` and sets in brackets (negated by ``^``)."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end]
            negated = inner.startswith("^")
            out += "[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", inner[negated:]) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)\\A{out}\\z"


class Field:
    """A column's name, to build predicates from."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, value):  # type: ignore[override]
        return Compare(self.name, "=", value)

    def __ne__(self, value):  # type: ignore[override]
        return Compare(self.name, "!=", value)

    def __gt__(self, value):
        return Compare(self.name, ">", value)

    def __ge__(self, value):
        return Compare(self.name, ">=", value)

    def __lt__(self, value):
        return Compare(self.name, "<", value)

    def __le__(self, value):
        return Compare(self.name, "<=", value)

    __hash__ = None  # type: ignore[assignment]

    def is_(self, value):
        return Compare(self.name, "is", value)

    def is_not(self, value):
        return Compare(self.name, "is not", value)

    def isin(self, *values):
        return Compare(self.name, "in", tuple(values))

    def between(self, low, high):
        return Compare(self.name, "between", (low, high))

    def is_null(self):
        return Compare(self.name, "is null")

    def is_not_null(self):
        return Compare(self.name, "is not null")

    def like(self, pattern: str):
        return Compare(self.name, "like", pattern)

    def glob(self, pattern: str):
        return Compare(self.name, "glob", pattern)

    def regexp(self, pattern: str):
        return Compare(self.name, "regexp", pattern)


def field(name: str) -> Field:
    return Field(name)


def wrap(condition: Predicate | Column | str) -> Predicate:
    """A predicate as it is; a Column or SQL text as a filter that bounds nothing."""
    if isinstance(condition, Predicate):
        return condition
    if isinstance(condition, str):
        return Plain(F.expr(condition))
    if isinstance(condition, Column):
        return Plain(condition)
    raise WhereClauseError(f"not a predicate: {condition!r}")
