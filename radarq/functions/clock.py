"""Times of day: delays over midnight, absolute times and grid slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0
# A difference below the first or from the second on comes from the day's turn.
LOWEST, HIGHEST = -86000.0, 86400.0 - 512.0
#: Delays of this size and more, in seconds, are no delays.
MOST_DELAY = 8.0


def delay(stamp: Column, tod: Column) -> Column:
    """Reception minus measurement time of day, over midnight either way."""
    d = stamp - tod
    return F.when(d <= LOWEST, d + DAY).when(d >= HIGHEST, d - DAY).otherwise(d)


def floor_to(value: Column, step: int) -> Column:
    return value - F.pmod(value, F.lit(step))


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000 + second


def timestamp_of(epoch_seconds: Column) -> Column:
    """Seconds since 1970 as a TIMESTAMP, to the microsecond."""
    return F.timestamp_micros(F.round(epoch_seconds * 1_000_000).cast("long"))
