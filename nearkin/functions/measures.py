"""Media time, percentages, interpolation and running statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_ms(ts: Column, first_ts: Column, tb_num: Column, tb_den: Column) -> Column:
    """Milliseconds from the first stamp on, rounded to the nearest, halves away from zero."""
    exact = (ts - first_ts).cast("decimal(38,0)") * tb_num * 1000
    return F.round(exact / tb_den.cast("decimal(10,0)"), 0).cast("long")


def duration_ms(ts: Column, first_ts: Column, tb_num: Column, tb_den: Column) -> Column:
    """Like `offset_ms`, but never below 0."""
    return F.greatest(offset_ms(ts, first_ts, tb_num, tb_den), F.lit(0).cast("long"))


def ticks(ms: Column, tb_num: Column, tb_den: Column) -> Column:
    """Stamp units in so many milliseconds."""
    return F.round(ms.cast("decimal(38,0)") * tb_den / (tb_num.cast("decimal(10,0)") * 1000), 0).cast("long")


def clock(ms: Column) -> Column:
    """[-]HH:MM:SS.mmm"""
    a = F.abs(ms)
    whole = lambda by: F.floor(a / by).cast("long")
    text = F.format_string("%02d:%02d:%02d.%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, a % 1000)
    return F.concat(F.when(ms < 0, "-").otherwise(""), text)


def frame_text(path: Column, ms: Column, mirrored: Column) -> Column:
    """"path":time:N or M"""
    return F.concat(F.lit('"'), path, F.lit('":'), clock(ms), F.lit(":"), F.substring(mirrored, 1, 1))


def percent_of(part: Column, total: Column) -> Column:
    """100 * part / total; an error where that is no finite number of 0 or more."""
    value = F.try_divide(F.lit(100.0) * part, total)
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(good, value).otherwise(F.raise_error(F.lit("not a percentage")).cast("double"))


def lerp(x0: Column, x1: Column, y0: Column, y1: Column, x: Column) -> Column:
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def lerp_whole(x0: Column, x1: Column, y0: Column, y1: Column, x: Column) -> Column:
    """Interpolation of whole numbers, cut off; null outside x0..x1 or where that is empty."""
    at = lambda c: c.cast("decimal(38,0)")
    up = F.call_function("div", at(x - x0) * at(F.abs(y1 - y0)), at(x1 - x0))  # a decimal quotient is rounded to six digits first
    return F.when((x0 < x1) & (x >= x0) & (x <= x1), F.when(y1 >= y0, y0 + up).otherwise(y0 - up))


def variance(x: Column) -> Column:
    """Sample variance; 0 for fewer than two values."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def biased_variance(x: Column) -> Column:
    """Population variance; 0 without values."""
    return F.coalesce(F.var_pop(x), F.lit(0.0))


def deviation(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))
