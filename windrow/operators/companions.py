"""Companions: data kept beside a table's windows and dropped with them.

A companion hears of every segment that is written, by appends as well as by updates and deletes, whose new segments
replace the old ones; so what it writes for a segment is in step with the table's rows by construction.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompanionError, WhereClauseError
from .knn import nearest


class Companion:
    """Base of companions. ``synced`` are the table's columns named first in the declaration's arguments."""

    def __init__(self, declared, spec):
        self.name, self.args = declared.name, declared.args
        names = {c.name for c in spec.columns}
        first = [m[0] for a in declared.args if (m := re.match(r"\w+", a))]
        self.synced = [n for n in first if n in names]
        if not self.synced:
            raise CompanionError(f"companion {self.name} names no column of the table")

    def on_rows_written(self, rows: DataFrame, path: str) -> None:
        """A segment was written; rows has its columns and ``_p``, path is where the companion's part of it goes."""

    def schema(self, table: T.StructType) -> T.StructType | None:
        """Columns of the companion's own rows; None if it has none."""
        return None

    def hidden_columns(self) -> list[T.StructField]:
        """Columns that only the companion's scans fill."""
        return []

    def on_windows_dropped(self, starts: list[int]) -> None:
        """Windows were dropped with their rows; what the companion wrote for them is deleted with the segments."""

    def drives_scan(self, column: str) -> bool:
        """Whether a search on a column is this companion's."""
        return False

    def scan(self, rows: DataFrame, column: str, wanted, k: int | None, condition: Column | None, order: tuple[str, ...] = (), **options) -> DataFrame:
        """What a search for ``wanted`` finds in rows, with the hidden columns; ``condition`` is the query's filter."""
        raise CompanionError(f"companion {self.name} has no search")


class VectorCompanion(Companion):
    """Nearest-neighbour search on a column of vectors. The vectors stay in the table's rows, so there is nothing to keep in step."""

    def hidden_columns(self) -> list[T.StructField]:
        return [T.StructField("k", T.LongType()), T.StructField("distance", T.DoubleType())]

    def drives_scan(self, column: str) -> bool:
        return column in self.synced

    def scan(self, rows, column, wanted, k, condition, order=(), mode="post", metric="l2", ties=()) -> DataFrame:
        """In mode ``post`` the k nearest rows are found and then filtered, in mode ``pre`` the rows are filtered first."""
        if k is None or isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise CompanionError("a search needs k, a number from 1 on")
        if mode not in ("post", "pre"):
            raise WhereClauseError("mode is post or pre")
        if condition is not None and mode == "pre":
            rows = rows.filter(condition)
        found = nearest(rows, column, wanted, k, metric, (*order, *ties))
        if condition is not None and mode == "post":
            found = found.filter(condition)
        return found.withColumn("k", F.lit(None).cast("long"))


class MirrorCompanion(Companion):
    """A copy of some columns, window by window."""

    def schema(self, table: T.StructType) -> T.StructType:
        return T.StructType([f for f in table if f.name in self.synced])

    def on_rows_written(self, rows: DataFrame, path: str) -> None:
        rows.select(*self.synced, "_p").write.partitionBy("_p").parquet(path)


_modules: dict[str, type[Companion]] = {"vec0": VectorCompanion, "mirror": MirrorCompanion}


def register_companion(module: str, kind: type[Companion]) -> None:
    """Make a kind of companion available to declarations."""
    _modules[module] = kind


def make_companion(declared, spec) -> Companion:
    if declared.module not in _modules:
        raise CompanionError(f"unknown companion module {declared.module!r}; known are {', '.join(sorted(_modules))}")
    return _modules[declared.module](declared, spec)
