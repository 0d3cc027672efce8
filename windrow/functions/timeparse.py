"""Points in time: as Spark columns and, for literals, in Python. Everything is UTC and independent of the session's zone."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TimestampParseError

# The accepted formats of texts, in order: Python format, Spark format, shape. Dates are midnight;
# times may have fractional seconds where the format has seconds after a colon.
FORMATS = (
    ("%Y-%m-%d %H:%M:%S", "y-M-d H:m:s", r"\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?"),
    ("%Y-%m-%d %H:%M", "y-M-d H:m", r"\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}"),
    ("%Y-%m-%d", "y-M-d", r"\d{3,4}-\d{1,2}-\d{1,2}"),
    ("%d-%m-%Y %H:%M:%S", "d-M-y H:m:s", r"\d{1,2}-\d{1,2}-\d{3,4} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?"),
    ("%d-%m-%Y %H:%M", "d-M-y H:m", r"\d{1,2}-\d{1,2}-\d{3,4} \d{1,2}:\d{1,2}"),
    ("%d-%m-%Y", "d-M-y", r"\d{1,2}-\d{1,2}-\d{3,4}"),
    ("%m/%d/%Y %H:%M:%S", "M/d/y H:m:s", r"\d{1,2}/\d{1,2}/\d{1,4} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?"),
    ("%m/%d/%Y %H:%M", "M/d/y H:m", r"\d{1,2}/\d{1,2}/\d{1,4} \d{1,2}:\d{1,2}"),
    ("%m/%d/%Y", "M/d/y", r"\d{1,2}/\d{1,2}/\d{1,4}"),
    ("%Y%m%d%H%M%S", "yyyyMMddHHmmss", r"\d{14}"),
    ("%Y%m%d", "yyyyMMdd", r"\d{8}"),
    ("%Y-%m-%dT%H:%M:%SZ", "y-M-d'T'H:m:s'Z'", r"\d{1,4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z"),
    ("%Y-%m-%dT%H:%M:%S%z", "y-M-d'T'H:m:s", r"\d{1,4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?[+-]\d{2}:?\d{2}"),
    ("%B %d, %Y %H:%M:%S", "MMMM d, y H:m:s", r"[A-Za-z]+ \d{1,2}, \d{1,4} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("%b %d, %Y %H:%M:%S", "MMM d, y H:m:s", r"[A-Za-z]{3} \d{1,2}, \d{1,4} \d{1,2}:\d{1,2}:\d{1,2}"),
)
#: Formats without a date, which name no point in time.
TIME_ONLY = (r"\d{1,2}:\d{2}:\d{2} [AaPp][Mm]", r"\d{1,2}:\d{2} [AaPp][Mm]")

EPOCH = dt.datetime(1970, 1, 1)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def parse_text(text: str) -> dt.datetime:
    """The point in time that a text names, without a zone (UTC); offsets are applied."""
    text = text.strip()
    for python, _, form in FORMATS:
        if not re.fullmatch(form, text, re.ASCII):
            continue
        whole, fraction = text, 0
        if (m := re.search(r":\d{1,2}(\.(\d{1,6}))", text)) and "%S" in python:
            whole, fraction = text.replace(m[1], "", 1), int(m[2].ljust(6, "0"))
        if "%B" in python and text.split(" ")[0].title() not in MONTHS:
            continue
        try:
            found = dt.datetime.strptime(whole, python) + dt.timedelta(microseconds=fraction)
        except ValueError:
            continue
        return found if found.tzinfo is None else found.astimezone(dt.UTC).replace(tzinfo=None)
    if any(re.fullmatch(form, text) for form in TIME_ONLY):
        raise TimestampParseError(f"a time without a date is no point in time: {text!r}")
    raise TimestampParseError(f"not a point in time: {text!r}")


def to_datetime(value) -> dt.datetime:
    """A literal (text, datetime, date, or epoch seconds) as a point in time."""
    if isinstance(value, dt.datetime):
        return value if value.tzinfo is None else value.astimezone(dt.UTC).replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, bool) or value is None or isinstance(value, bytes):
        raise TimestampParseError(f"not a point in time: {value!r}")
    if isinstance(value, int | float):
        return EPOCH + dt.timedelta(seconds=math.trunc(value))
    return parse_text(str(value))


def to_epoch(value) -> int:
    """Epoch seconds of a literal, floored."""
    since = to_datetime(value) - EPOCH
    return since.days * 86400 + since.seconds


def partition_value(value, interval: int) -> int:
    """The start of the window that a literal falls into; a true floor, before 1970 too."""
    seconds = to_epoch(value)
    return seconds - seconds % interval


def _text_column(col: Column) -> Column:
    """A text column as timestamps without zone; null where it names none."""
    text = F.trim(col)
    out = F.lit(None).cast("timestamp_ntz")
    for _, spark, form in reversed(FORMATS):
        value = F.regexp_replace(text, r"(:\d{1,2})\.\d{1,6}", "$1") if r"(\.\d" in form else text
        if "[+-]" in form:
            offset = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 1).cast("int") * 3600
            minutes = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 2).cast("int") * 60
            value = F.regexp_replace(value, r"[+-]\d{2}:?\d{2}$", "")
            found = F.try_to_timestamp(value, F.lit(spark)).cast("timestamp_ntz")
            found = found - F.make_dt_interval(secs=F.when(text.rlike(r"-\d{2}:?\d{2}$"), offset - minutes).otherwise(offset + minutes))
        else:
            found = F.try_to_timestamp(value, F.lit(spark)).cast("timestamp_ntz")
        if r"(\.\d" in form:
            fraction = F.rpad(F.regexp_extract(text, r":\d{1,2}\.(\d{1,6})", 1), 6, "0").cast("int")
            found = found + F.make_dt_interval(secs=F.coalesce(fraction, F.lit(0)) / F.lit(1000000).cast("decimal(18,6)"))
        out = F.coalesce(F.when(text.rlike(f"^(?:{form})$"), found), out)
    return out


def to_timestamp(col: Column, kind: T.DataType) -> Column:
    """A column of any accepted type (text, epoch seconds, date, timestamp) as timestamps without zone."""
    if isinstance(kind, T.StringType):
        return _text_column(col)
    if isinstance(kind, T.IntegralType | T.FractionalType):
        return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=col.cast("long"))
    return col.cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without zone, floored, from its calendar fields alone."""
    return F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def partition_column(ts: Column, interval: int) -> Column:
    """The start of the window that a timestamp without zone falls into."""
    seconds = epoch_seconds(ts)
    return seconds - F.pmod(seconds, F.lit(interval))
