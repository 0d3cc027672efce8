"""Intervals and lifetimes as seconds."""

from __future__ import annotations

import re

from ..errors import ParseIntervalError

#: The units and their seconds.
UNITS = {"hour": 3600, "day": 86400}


def parse_interval(text: str) -> int:
    """Seconds of ``<number> hour`` or ``<number> day``; units are lower-case and singular, and zero isn't allowed."""
    found = re.search(r"(\d+)\s+(\w+)", text)
    if not found:
        raise ParseIntervalError(f"not an interval: {text!r}")
    if found[2] not in UNITS:
        raise ParseIntervalError(f"unknown unit {found[2]!r}; known are {', '.join(UNITS)}")
    if not (seconds := int(found[1]) * UNITS[found[2]]):
        raise ParseIntervalError("an interval of no length")
    return seconds


def parse_lifetime(text: str) -> int | None:
    """Seconds of ``lifetime <number> <unit>``; None for text that isn't about a lifetime."""
    words = text.split()
    if not words or words[0].lower() != "lifetime":
        return None
    if len(words) != 3:
        raise ParseIntervalError(f"a lifetime has a number and a unit: {text!r}")
    return parse_interval(f"{words[1]} {words[2]}")
