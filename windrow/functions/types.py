"""Declared column types and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import ParseValueTypeError

#: Declared type, case-insensitive, and Spark type. Those from REAL on are accepted beyond the classic five.
TYPES = {
    "INT": T.LongType(),
    "INTEGER": T.LongType(),
    "TEXT": T.StringType(),
    "VARCHAR": T.StringType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "FLOAT": T.DoubleType(),
    "BLOB": T.BinaryType(),
    "JSON": T.StringType(),
    "NULL": T.NullType(),
    "REAL": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "VECTOR": T.ArrayType(T.FloatType()),
}


def parse_type(name: str) -> T.DataType:
    try:
        return TYPES[name.strip().upper()]
    except KeyError:
        raise ParseValueTypeError(f"unknown column type {name!r}; known are {', '.join(TYPES)}") from None


def type_name(kind: T.DataType) -> str:
    """The first declared name of a Spark type."""
    return next((n for n, t in TYPES.items() if t == kind), kind.simpleString().upper())
