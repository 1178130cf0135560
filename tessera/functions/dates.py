"""Date arithmetic with pandas-style whole days and safe parsing.

Whole days are the floor of the exact time difference over 24 h (what
``Timedelta.days`` gives), not calendar-day differences: 23:00 -> 01:00 next
day is 0 days.  Differences are taken in microseconds so that neither the
session time zone nor daylight-saving changes can shift them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

MICROS_PER_DAY = 86_400_000_000


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))


def whole_days(start, end) -> Column:
    """floor((end - start) / 24h) as a long; null if either side is null."""
    return F.floor(micros_between(start, end) / F.lit(MICROS_PER_DAY)).cast("long")


def parse_timestamp_safe(c, fmt: str | None = None) -> Column:
    """Parse text to a timestamp; unparsable values become null."""
    x = col_of(c)
    return F.try_to_timestamp(x, F.lit(fmt)) if fmt else F.try_to_timestamp(x)


def age_at_event(event, birth, sentinel_year: int = 2100, cap: float = 120,
                 sentinel_age: float = 90) -> Column:
    """Age in years = whole days / 365.25; sentinel birth year -> 90;
    ages outside [0, cap] -> null."""
    ev, b = col_of(event), col_of(birth)
    age = whole_days(b, ev) / F.lit(365.25)
    return (F.when(ev.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(F.year(b) == sentinel_year, F.lit(float(sentinel_age)))
            .when((age < 0) | (age > cap), F.lit(None).cast("double"))
            .otherwise(age))


def age_as_of(birth, as_of) -> Column:
    """floor(whole days / 365) from ``birth`` to the ``as_of`` date/timestamp."""
    return F.floor(whole_days(birth, as_of) / F.lit(365)).cast("long")


def length_of_stay(start, end, cap: int = 365) -> Column:
    d = whole_days(start, end)
    return F.when((d < 0) | (d > cap), F.lit(None).cast("long")).otherwise(d)


def in_interval_flag(t, start, end, sentinel_year: int | None = 2100) -> Column:
    """start <= t <= end; any null or a sentinel-year ``t`` -> False."""
    t_, s, e = col_of(t), col_of(start), col_of(end)
    cond = (s <= t_) & (t_ <= e)
    if sentinel_year is not None:
        cond = cond & (F.year(t_) != sentinel_year)
    return F.coalesce(cond, F.lit(False))


def duration_days(start, stop) -> Column:
    return whole_days(start, stop)


def to_number_safe(c) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return col_of(c).try_cast("double")
