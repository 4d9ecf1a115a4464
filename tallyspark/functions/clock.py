"""Clock times as seconds of the day."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def seconds_of_day(timestamp: Column) -> Column:
    return F.hour(timestamp) * 3600 + F.minute(timestamp) * 60 + F.second(timestamp)


def floor_minute(seconds: Column) -> Column:
    return seconds - seconds % 60


def circular_mean_seconds(seconds: Column) -> Column:
    """Mean time of day on the 24-hour circle (23:00 and 01:30 give 00:15).

    Two partial averages and one arctangent. Fractions of a second are cut off
    towards midnight, after a nudge of a microsecond so that a mean lying on a
    whole second is not lost to floating point.
    """
    angle = seconds.cast("double") * F.lit(2 * math.pi / DAY)
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * F.lit(DAY / (2 * math.pi))
    whole = (mean + F.signum(mean) * F.lit(1e-6)).cast("bigint")
    return F.pmod(whole, F.lit(DAY)).cast("bigint")


def clock_text(seconds: Column, twelve_hour: bool = False, suffix: bool = False) -> Column:
    """``HH:MM``, or the twelve-hour form with or without AM/PM."""
    day_seconds = F.pmod(seconds.cast("bigint"), F.lit(DAY))
    hour = F.floor(day_seconds / 3600)
    minute = F.floor(day_seconds % 3600 / 60)
    if not twelve_hour:
        return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", hour, minute))
    shown = F.format_string("%02d:%02d", (hour + 11) % 12 + 1, minute)
    if suffix:
        shown = F.concat(shown, F.when(hour < 12, " AM").otherwise(" PM"))
    return F.when(seconds.isNotNull(), shown)
