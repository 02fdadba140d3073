"""Scalar functions of time, identity and text; columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_zt(ts: Column, lights_on: Column) -> Column:
    """Hours since lights on, 0 to below 24, with fraction."""
    return F.pmod(F.hour(ts) + F.minute(ts) / F.lit(60.0) - lights_on, F.lit(24.0))


def zt(ts: Column, lights_on: Column) -> Column:
    return F.floor(raw_zt(ts, lights_on)).cast("int")


def rounded_zt(ts: Column, lights_on: Column) -> Column:
    """Half to even, 24 as 0."""
    return F.pmod(F.bround(raw_zt(ts, lights_on), 0), F.lit(24.0)).cast("int")


def phase(ts: Column, lights_on: Column) -> Column:
    return F.when(raw_zt(ts, lights_on) < 12, "Light").otherwise("Dark")


def exp_day(day: Column, start: Column) -> Column:
    """1 on the start date."""
    return F.datediff(day, start) + 1


def load_date(text: Column) -> Column:
    """MM/DD/YY; null if it is no date."""
    return F.try_to_timestamp(text, F.lit("MM/dd/yy")).cast("date")


def is_ok(c: Column, nan_is_ok: bool = False) -> Column:
    """Neither null nor one of the spellings of nothing, case and blanks aside."""
    nothing = ["", "na"] + ([] if nan_is_ok else ["nan"])
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin(nothing)


def fly_id(monitor: Column, channel: Column) -> Column:
    """M<monitor>_Ch<channel of two digits>; longer channels are kept whole."""
    text = channel.cast("string")
    return F.concat(F.lit("M"), monitor, F.lit("_Ch"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def fly_key(monitor: Column, channel: Column) -> Column:
    return F.concat(monitor.cast("string"), F.lit("-ch"), F.regexp_replace(F.lower(channel.cast("string")), "^ch", ""))


def on_circle(hour: Column, period: float = 24.0) -> tuple[Column, Column]:
    """sin and cos of an hour on a period."""
    angle = F.lit(2.0) * F.pi() * hour / F.lit(period)
    return F.sin(angle), F.cos(angle)


def clipped(c: Column, low: float, high: float) -> Column:
    """Into the bounds; NaN and infinite as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), d)))


def number_or_null(c: Column) -> Column:
    """NaN as null, so that aggregates pass over it."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def monitor_of_file(name: Column) -> Column:
    """What follows ``Monitor`` in a file name, else its first digits."""
    after = F.regexp_extract(name, r"Monitor([^/]*?)(?:\.[A-Za-z]+)?$", 1)
    return F.when(after != "", after).otherwise(F.regexp_extract(name, "([0-9]+)", 1))


def reading_type_of_file(name: Column) -> Column:
    """MT, CT or Pn out of a file name."""
    return F.nullif(F.regexp_extract(name, "(MT|CT|Pn)", 1), F.lit(""))


def output_name(stem: Column, minutes: int) -> Column:
    return F.format_string(f"%s_{minutes}min.csv", F.regexp_replace(stem, r"\.[A-Za-z]+$", ""))
