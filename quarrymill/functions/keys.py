"""Normal forms of keys, names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as blanks around a key.
BLANKS = " \t\n\r\f\u000b\u00a0"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def loose_key(c: Column) -> Column:
    """A key compared without case and surrounding blanks; blank is null."""
    k = F.lower(trimmed(c))
    return F.when(k != "", k)


def event_kind(c: Column) -> Column:
    """snake_case and CamelCase spellings of an event type, as one word in lower case."""
    return F.regexp_replace(F.lower(trimmed(c)), "_", "")


def epoch_seconds(c: Column, millis_from: int = 100_000_000_000) -> Column:
    """Whole epoch seconds from seconds or, at millis_from and above, milliseconds."""
    return F.when(c >= millis_from, F.floor(c / 1000)).otherwise(c).cast("bigint")


def micros(c: Column) -> Column:
    """Epoch microseconds of a timestamp with or without a zone (session zone UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def day_text(day: Column) -> Column:
    """YYYY-MM-DD of days since the epoch."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")
