"""Exact nearest neighbours within windows, as DataFrame expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WhereClauseError

METRICS = ("l2", "l1", "cosine")
#: Components up to which a distance is written out, which Spark compiles; longer vectors are folded over.
WRITTEN_OUT = 128
#: The name under which a search holds the vectors.
OWN = "_windrow_vector"


def as_vector(value: Iterable[float] | str) -> list[float]:
    """A query vector from numbers or from JSON text."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError as error:
            raise WhereClauseError(f"not a vector: {value!r}") from error
    out = [float(x) for x in value]
    if not out:
        raise WhereClauseError("a vector without components")
    return out


def distance(vector: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance of a column of vectors to a query, in double precision, summed in the order of the components.

    Vectors must be of the query's length; a vector that is null or has a null component has no distance,
    nor has the zero vector by cosine.
    """
    if metric not in METRICS:
        raise WhereClauseError(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    vector = vector.cast("array<double>")
    total = lambda values, term: F.aggregate(values, F.lit(0.0), lambda sum_, x: sum_ + term(x))
    paired = lambda term: F.zip_with(vector, F.array(*map(F.lit, query)), term)
    if metric == "l2":
        return F.sqrt(total(paired(lambda x, q: x - q), lambda x: x * x))
    if metric == "l1":
        return total(paired(lambda x, q: x - q), F.abs)
    norm = sum(q * q for q in query) ** 0.5
    return 1 - F.try_divide(total(paired(lambda x, q: x * q), lambda x: x), F.sqrt(total(vector, lambda x: x * x)) * norm)


def written_out(name: str, query: list[float], metric: str) -> Column:
    """The same for a column by its name, as one sum that Spark compiles; the text is parsed at once, which the calls for as many Columns would not be."""
    numbers = [f"{q!r}D" if math.isfinite(q) else f"double('{q}')" for q in query]
    pairs = [(f"cast(get({name}, {i}) as double)", f"({q})") for i, q in enumerate(numbers)]
    if metric == "l2":
        return F.expr(f"sqrt({' + '.join(f'({x} - {q}) * ({x} - {q})' for x, q in pairs)})")
    if metric == "l1":
        return F.expr(" + ".join(f"abs({x} - {q})" for x, q in pairs))
    norm = sum(q * q for q in query) ** 0.5
    return F.expr(f"1 - try_divide({' + '.join(f'{x} * {q}' for x, q in pairs)}, sqrt({' + '.join(f'{x} * {x}' for x, _ in pairs)}) * double('{norm!r}'))")


def nearest(rows: DataFrame, column: str, query: Iterable[float] | str, k: int, metric: str = "l2", ties: Iterable[str] = ()) -> DataFrame:
    """The k rows nearest to a query with their ``distance``; each task keeps k rows, and those are merged.

    Vectors of another length than the query's, and those without a distance, are left out. The distance stands
    once in the plan: filtering by it before the limit would have it computed twice for each row.
    """
    query = as_vector(query)
    vector = F.from_json(column, "array<double>") if isinstance(rows.schema[column].dataType, T.StringType) else F.col(column)
    fitting = rows.filter(F.size(vector) == len(query))
    if len(query) <= WRITTEN_OUT and metric in METRICS:
        fitting = fitting.withColumn(OWN, vector).withColumn("distance", written_out(OWN, query, metric)).drop(OWN)
    else:
        fitting = fitting.withColumn("distance", distance(vector, query, metric))
    return fitting.orderBy(F.asc_nulls_last("distance"), *ties).limit(k).filter(F.col("distance").isNotNull())
