"""Errors of partitioned tables."""


class TableError(Exception):
    """Base of all errors of this package."""


class ColumnTypeMismatch(TableError):
    """A value that does not suit its column."""


class ColumnDeclarationError(TableError):
    """A column declaration that can't be read."""


class ParseValueTypeError(TableError):
    """A column type that isn't known."""


class ParseIntervalError(TableError):
    """An interval or lifetime that can't be read."""


class PartitionColumnError(TableError):
    """A missing or unsuitable partition column, or a row without a value in it."""


class TimestampParseError(TableError):
    """A literal that is no point in time."""


class WhereClauseError(TableError):
    """A predicate that can't be evaluated."""


class MatchRequiresCompanion(WhereClauseError):
    """A vector search on a column without a vector companion."""


class CompanionError(TableError):
    """A companion clause, module or search parameter that isn't valid."""


class CommitConflict(TableError):
    """Another writer committed the same version of a table."""
