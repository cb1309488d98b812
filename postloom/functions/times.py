"""Time functions as columns: all instants are whole seconds since 1970-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the units of relative stamps.
UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "w": 604800, "mo": 2592000, "y": 31536000, "yr": 31536000}


def relative_epoch(col: Column, now: Column) -> Column:
    """What a relative stamp (3h, 2d, 1 w, yesterday, just now) means, seen at ``now``; null for all else."""
    s = F.lower(F.trim(col))
    pattern = r"^(\d{1,4})\s*(s|secs?|m|mins?|h|hrs?|d|days?|w|weeks?|mo|months?|y|yrs?|years?)(?:\s+ago)?$"
    unit = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, pattern, 2), "^(d|w|y)[a-z]+$", "$1"), "^(mo|sec|min|hr)[a-z]*$", "$1")
    seconds = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)
    ago = F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1).cast("bigint") * seconds)
    return F.when(s == "just now", now).when(s == "yesterday", now - 86400).otherwise(now - ago)


def month_key(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def day_key(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def month_span(first: Column, last: Column) -> Column:
    """Two instants as a range of months, or one month where both lie in it."""
    a, b = (F.date_format(F.timestamp_seconds(x), "MMMM yyyy") for x in (first, last))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" — "), b))


def wall_iso(epoch: Column, zone: str = "+08:00") -> Column:
    """An instant as ISO text on the clock of a zone of fixed offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def valid_epoch(epoch: Column, low: int, high: int) -> Column:
    """Null where an instant lies outside its bounds."""
    return F.when(epoch.between(low, high), epoch)
