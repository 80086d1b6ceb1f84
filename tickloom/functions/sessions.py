"""Session buckets, reset anchors and other clock functions as Columns.

Times are UTC. Timestamps may be with or without zone (the session zone is UTC).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange windows in local seconds of the day, and the venue's
# rollover; UTC hour windows of the bar replay; capture windows in UTC seconds.
EXCHANGES = (("Asia/Tokyo", 9 * 3600, 15 * 3600, "asia"), ("Europe/London", 8 * 3600, 16 * 3600 + 1800, "london"), ("America/New_York", 8 * 3600, 17 * 3600, "new_york"))
ROLLOVER_FROM, ROLLOVER_TO = 23 * 3600 + 55 * 60, 5 * 60
SESSIONS = ("asia", "london", "new_york", "overlap", "rollover")


def local(ts: Column, zone: str) -> Column:
    """Wall-clock time in a zone, without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def session_bucket(ts: Column, venue_zone: str = "Europe/Prague") -> Column:
    """Session of an instant, following daylight saving; null outside all."""
    venue = second_of_day(local(ts, venue_zone))
    open_ = {}
    for zone, start, end, name in EXCHANGES:
        s = second_of_day(local(ts, zone))
        open_[name] = (s >= start) & (s < end)
    return (
        F.when((venue >= ROLLOVER_FROM) | (venue < ROLLOVER_TO), "rollover")
        .when(open_["london"] & open_["new_york"], "overlap")
        .when(open_["london"], "london")
        .when(open_["new_york"], "new_york")
        .when(open_["asia"], "asia")
    )


def known_session(ts: Column, venue_zone: str = "Europe/Prague") -> Column:
    return F.coalesce(session_bucket(ts, venue_zone), F.lit("unknown"))


def hour_session(hour: Column) -> Column:
    """Fixed UTC sessions of the bar replay."""
    return F.when((hour >= 22) | (hour < 1), "rollover").when(hour < 7, "asia").when(hour < 12, "london").when(hour < 13, "overlap").when(hour < 17, "new_york").otherwise("asia")


def capture_bucket(ts: Column) -> Column:
    """Provisional capture buckets in UTC; the afternoon counts as overlap."""
    s = second_of_day(ts)
    return F.when((s >= ROLLOVER_FROM) | (s < ROLLOVER_TO), "rollover").when((s >= 12 * 3600) & (s < 16 * 3600 + 1800), "overlap").when(s < 7 * 3600, "asia").when((s >= 7 * 3600) & (s < 12 * 3600), "london")


def reset_anchor(ts: Column, zone: str, reset: str = "00:00") -> Column:
    """The local reset instant at or before ts, in UTC. A reset that falls into a
    skipped hour moves as the zone database moves it; one in a repeated hour is
    the earlier of the two."""
    parts = [int(x) for x in reset.split(":")]
    seconds = parts[0] * 3600 + parts[1] * 60 + (parts[2] if len(parts) > 2 else 0)
    shift = F.make_dt_interval(secs=F.lit(seconds))
    at = F.date_trunc("DAY", local(ts, zone) - shift).cast("timestamp_ntz") + shift
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), at)


def spans_saturday(a: Column, b: Column) -> Column:
    """Whether a Saturday lies between the days of a and b, both included."""
    return F.exists(F.sequence(F.to_date(a), F.to_date(b)), lambda d: F.weekday(d) == 5)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def swap_multiplier(day: Column, triple: tuple[int, ...], holidays: tuple[str, ...] = ()) -> Column:
    """3 on a triple-swap weekday (Monday 0) that is no holiday, else 1."""
    hits = reduce(lambda x, y: x | y, [F.weekday(day) == d for d in triple], F.lit(False))
    off = F.array_contains(F.array(*[F.lit(h) for h in holidays]).cast("array<string>"), F.date_format(day, "yyyy-MM-dd"))
    return F.when(hits & ~off, 3).otherwise(1)


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def timeframe_seconds(text: str) -> int:
    """Seconds of '<positive int><s|m|h|d>'."""
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a positive timeframe: {text!r}")
    return int(m[1]) * _UNITS[m[2]]
