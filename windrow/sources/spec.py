"""What a partitioned table is declared as, and the parser of declarations."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from ..errors import ColumnDeclarationError, CompanionError, ParseIntervalError, PartitionColumnError
from ..functions.interval import parse_interval, parse_lifetime
from ..functions.types import parse_type, type_name


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    partition: bool = False


@dataclass(frozen=True)
class CompanionDecl:
    """``companion <name> USING <module>(<args>)``"""

    name: str
    module: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class IndexDecl:
    """A named secondary index on one or more columns."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    """A table's windows, columns, lifetime, companions and indexes.

    An index is a layout of the files: every column of an index gets a Bloom filter, and rows are sorted inside a file,
    after the partition column, by the columns of the indexes in order. ``sort_within`` and ``bloom`` ask for either on
    its own. Every window's files have the layout that holds when they are written; compaction writes them anew.
    """

    interval: int
    columns: tuple[ColumnSpec, ...]
    lifetime: int | None = None
    companions: tuple[CompanionDecl, ...] = ()
    sort_within: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    batch_size: int = 1000
    text_compat: bool = field(default=False)
    indexes: tuple[IndexDecl, ...] = ()

    @property
    def sorted_by(self) -> tuple[str, ...]:
        every = (*self.sort_within, *(c for i in self.indexes for c in i.columns))
        return tuple(c for c in dict.fromkeys(every) if c != self.partition_column)

    @property
    def bloomed(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.bloom, *(c for i in self.indexes for c in i.columns if c != self.partition_column))))

    def __post_init__(self):
        self.partition_column  # noqa: B018  raises where there is none
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) != len(names):
            raise ColumnDeclarationError("columns must have different names")
        if len({c.name for c in self.companions}) != len(self.companions):
            raise CompanionError("companions must have different names")
        if len({i.name for i in self.indexes}) != len(self.indexes):
            raise ColumnDeclarationError("indexes must have different names")
        if unknown := {c for i in self.indexes for c in i.columns} | set(self.sort_within) | set(self.bloom):
            if unknown := unknown - {c.name for c in self.columns}:
                raise ColumnDeclarationError(f"an index on columns that aren't there: {', '.join(sorted(unknown))}")

    @property
    def partition_column(self) -> str:
        found = next((c for c in self.columns if c.partition), None)
        if found is None:
            raise PartitionColumnError("one column must be the partition_column")
        if not isinstance(parse_type(found.type), T.StringType | T.TimestampNTZType):
            raise PartitionColumnError(f"a partition column is a timestamp or text, not {found.type}")
        return found.name

    def spark_type(self, column: ColumnSpec) -> T.DataType:
        if column.name == self.partition_column:
            return T.StringType() if self.text_compat else T.TimestampNTZType()
        return parse_type(column.type)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, self.spark_type(c)) for c in self.columns])

    @staticmethod
    def from_schema(schema: T.StructType, partition: str, interval: str | int, **options) -> TableSpec:
        """A declaration from a Spark schema."""
        seconds = parse_interval(interval) if isinstance(interval, str) else interval
        return TableSpec(seconds, tuple(ColumnSpec(f.name, type_name(f.dataType), f.name == partition) for f in schema), **options)

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> TableSpec:
        columns = tuple(ColumnSpec(**c) for c in data["columns"])
        companions = tuple(CompanionDecl(c["name"], c["module"], tuple(c["args"])) for c in data["companions"])
        return TableSpec(**data | {"columns": columns, "companions": companions, "sort_within": tuple(data["sort_within"]), "bloom": tuple(data["bloom"]), "indexes": tuple(IndexDecl(i["name"], tuple(i["columns"])) for i in data["indexes"])})


def parse_column(text: str) -> ColumnSpec:
    """``name type [partition_column]``"""
    words = text.split()
    if len(words) not in (2, 3) or len(words) == 3 and words[2].lower() != "partition_column":
        raise ColumnDeclarationError(f"a column is a name, a type and perhaps partition_column: {text!r}")
    parse_type(words[1])
    return ColumnSpec(words[0], words[1].upper(), len(words) == 3)


def parse_companion(text: str) -> CompanionDecl | None:
    """A companion clause; None for text that isn't one."""
    if not re.match(r"companion\b", text.strip(), re.IGNORECASE):
        return None
    found = re.fullmatch(r"companion\s+(\w+)\s+using\s+(\w+)\s*\((.*)\)", text.strip(), re.IGNORECASE | re.DOTALL)
    if not found:
        raise CompanionError(f"a companion is declared as: companion <name> USING <module>(<args>), not {text!r}")
    return CompanionDecl(found[1], found[2], tuple(a.strip() for a in split_top(found[3]) if a.strip()))


def split_top(text: str) -> list[str]:
    """Text split at the commas that aren't in parentheses or brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def parse_spec(text: str, **options) -> TableSpec:
    """A declaration: the interval first, then columns, at most one lifetime and any companions, separated by commas."""
    first, *rest = (p.strip() for p in split_top(text))
    interval = parse_interval(first)
    lifetime, columns, companions = None, [], []
    for part in rest:
        if (seconds := parse_lifetime(part)) is not None:
            if lifetime is not None:
                raise ParseIntervalError("a table has one lifetime")
            lifetime = seconds
        elif (companion := parse_companion(part)) is not None:
            companions.append(companion)
        else:
            columns.append(parse_column(part))
    return TableSpec(interval, tuple(columns), lifetime, tuple(companions), **options)
