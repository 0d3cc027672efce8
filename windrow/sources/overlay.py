"""Partitioned scans over any DataFrame with a timestamp column, without storage of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.interval import parse_interval
from ..functions.timeparse import partition_column, to_timestamp
from ..plans.predicates import Predicate, wrap

WINDOW = "_p"


class Overlay:
    """A DataFrame seen as windows of a fixed interval.

    Filters on the partition column reach the files as filters on that column (row-group statistics skip what they
    can); the window's start is a derived column, added only where it is asked for.
    """

    def __init__(self, df: DataFrame, partition: str, interval: str | int):
        self.df, self.partition = df, partition
        self.interval = parse_interval(interval) if isinstance(interval, str) else interval
        self.kind = df.schema[partition].dataType

    @property
    def window(self) -> Column:
        return partition_column(to_timestamp(F.col(self.partition), self.kind), self.interval)

    def scan(self, where: Predicate | Column | str | None = None, window: bool = False) -> DataFrame:
        """The rows that satisfy ``where``; with ``window`` their window's start as ``_p``."""
        out = self.df
        if where is not None:
            predicate = wrap(where)
            bounds = predicate.bounds(self.partition, self.interval)
            if not bounds.spans:
                out = out.filter(F.lit(False))
            out = out.filter(predicate.column(self.partition))
        return out.withColumn(WINDOW, self.window) if window else out

    def latest(self, n: int, *ties: str) -> DataFrame:
        """The n newest rows, newest first; ties in the order of the columns given."""
        return self.df.orderBy(F.desc(self.partition), *ties).limit(n)

    def stats(self, where: Predicate | Column | str | None = None) -> DataFrame:
        """(p, row_count) of every window with rows."""
        return self.scan(where, window=True).groupBy(F.col(WINDOW).alias("p")).agg(F.count(F.lit(1)).alias("row_count"))
