"""Durations and instants taken from parameters."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# Unit names accepted in durations such as "3650 days".
UNITS = {
    "days": ("d", "day", "days"),
    "hours": ("h", "hour", "hours"),
    "minutes": ("m", "min", "mins", "minute", "minutes"),
    "seconds": ("s", "sec", "secs", "second", "seconds"),
    "milliseconds": ("ms", "milli", "millis", "millisecond", "milliseconds"),
}


def duration(text: str | timedelta) -> timedelta:
    """Parse "90 days", "12 hours", "30s"; whole seconds, like the ranking windows."""
    if isinstance(text, timedelta):
        return text
    match = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    for unit, names in UNITS.items():
        if match and match.group(2).lower() in names:
            whole = timedelta(**{unit: int(match.group(1))})
            return timedelta(seconds=whole // timedelta(seconds=1))
    raise ValueError(f"not a duration: {text!r}")


def instant(value: datetime | str) -> datetime:
    """An ISO-8601 string or a datetime, as a datetime."""
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def instant_literal(value: datetime | str, like: DataType) -> Column:
    """A literal of the same timestamp type as the column it is compared with."""
    return F.lit(instant(value).isoformat()).cast(like)


def whole_ms(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)
