"""Time functions. ``now`` is always an argument, so results do not depend on run time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600, 86_400


def epoch_seconds(timestamp: Column) -> Column:
    """Whole seconds since the epoch, fractions dropped."""
    return F.unix_seconds(timestamp.cast("timestamp"))


def uptime_clock(seconds: Column) -> Column:
    """``HH:MM:SS`` of the time of day, so a full day starts again at zero."""
    in_day = F.pmod(seconds.cast("bigint"), F.lit(DAY))
    hours = F.floor(in_day / 3600)
    minutes = F.floor(F.pmod(in_day, F.lit(3600)) / 60)
    return F.format_string("%02d:%02d:%02d", hours, minutes, F.pmod(in_day, F.lit(60)))


def format_duration(seconds: Column) -> Column:
    """``H:MM:SS``, led by ``1 day, `` or ``N days, `` when the day count is not zero."""
    seconds = seconds.cast("bigint")
    days = F.floor(seconds / DAY)
    in_day = F.pmod(seconds, F.lit(DAY))
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(in_day / 3600),
        F.floor(F.pmod(in_day, F.lit(3600)) / 60),
        F.pmod(in_day, F.lit(60)),
    )
    day_word = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), day_word, clock))


# Unit names with the count of each unit that makes one of the next.
AGE_UNITS = (
    ("second", 60.0),
    ("minute", 60.0),
    ("hour", 24.0),
    ("day", 7.0),
    ("week", 365.0 / 7.0 / 12.0),
    ("month", 12.0),
    ("year", None),
)


def time_ago(epoch: Column, now: Column) -> Column:
    """Age of ``epoch`` seen from ``now`` (both epoch seconds) as text such as ``3 hours ago``."""
    amount = F.greatest(now - epoch, F.lit(0)).cast("double")
    label = F.when(amount < 10, F.lit("just now"))
    for unit, per_next in AGE_UNITS:
        whole = F.floor(amount)
        text = F.concat(
            whole.cast("string"), F.when(whole == 1, f" {unit} ago").otherwise(f" {unit}s ago")
        )
        if per_next is None:
            return label.otherwise(text)
        label = label.when(amount < per_next, text)
        amount = amount / per_next
