"""Time expressions: epoch, service day, clock strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these constants.
EPOCH_2025_US = 1735689600000000
CAMPUS_TZ = "America/New_York"
DAY_START_SECONDS = 0
MIDNIGHT_LAST = 1440
CLOCK_PATTERN = r"^\s*(\d{1,2}):(\d{2})\s+([AaPp][Mm])\s*$"


def micros(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(us)


def epoch_seconds(ts) -> Column:
    """Seconds since 2025-01-01T00:00Z, fraction kept."""
    return (micros(ts) - F.lit(EPOCH_2025_US)) / F.lit(1e6)


def parse_iso(text) -> Column:
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def service_day_start(now, tz: str = CAMPUS_TZ, start_seconds: int = DAY_START_SECONDS) -> Column:
    """UTC instant of the most recent service-day start at or before ``now``."""
    now = F.col(now) if isinstance(now, str) else now
    shift = F.expr(f"INTERVAL {int(start_seconds)} SECOND")
    local = F.from_utc_timestamp(now, tz)
    return F.to_utc_timestamp(F.date_trunc("day", local - shift) + shift, tz)


def minute_of_day(clock: Column) -> Column:
    """``h:mm AM/PM`` as minutes after midnight; NULL for anything else."""
    part = lambda i: F.regexp_extract(clock, CLOCK_PATTERN, i)
    hour = part(1).try_cast("int") % 12 + F.when(F.upper(part(3)) == "PM", 12).otherwise(0)
    return F.when(clock.rlike(CLOCK_PATTERN), hour * 60 + part(2).try_cast("int"))


def departure_order(minute: Column) -> Column:
    """Sort key of a departure: a loop at 12:00 AM belongs to the end of the day."""
    return F.when(minute == 0, F.lit(MIDNIGHT_LAST)).otherwise(minute)


def clock_text(minute: Column) -> Column:
    """Minutes after midnight as ``h:mm AM/PM``."""
    m = F.pmod(minute, F.lit(1440))
    hour12 = F.pmod(F.floor(m / 60) + 11, F.lit(12)) + 1
    return F.concat(hour12.cast("string"), F.lit(":"), F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0"),
                    F.when(m < 720, F.lit(" AM")).otherwise(F.lit(" PM")))


def day_name(ts) -> Column:
    return F.upper(F.date_format(ts, "EEEE"))


def to_minute(ts) -> Column:
    return F.date_trunc("minute", ts)


def data_age_label(age_seconds: Column) -> Column:
    return F.when(age_seconds < 10, "Live").when(age_seconds < 30, "Delayed").when(age_seconds.isNotNull(), "Stale")
