"""Date expressions. All of them assume a UTC session."""

from pyspark.sql import Column, functions as F


def epoch_to_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def sunday_week(ts: Column) -> Column:
    """``2024-W07``: weeks start on Sunday, days before the first Sunday are week 00."""
    d = F.to_date(ts)
    week = F.floor((F.dayofyear(d) - 1 + 7 - (F.dayofweek(d) - 1)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
