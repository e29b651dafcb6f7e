"""Small column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 8.64e10


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from `earlier` to `later`."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_DAY)


def as_ts(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def days(n: float) -> Column:
    """A day-time interval of `n` days."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * 86400.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def ratio(num: Column, den: Column, floor: float = 1.0) -> Column:
    """num / max(floor, den): the guarded division used by every rate."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(float(floor)))


def count_where(cond: Column) -> Column:
    return F.coalesce(F.count_if(cond), F.lit(0))


def sum_where(value: Column, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def money(c: Column) -> Column:
    """Money is a double kept at two decimals, which also hides the order a sum was taken in."""
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def parse_timestamp(c: Column, data_type: str) -> Column:
    """Epoch milliseconds (> 1e11), epoch seconds or text to a timestamp; what cannot be read is null."""
    if data_type in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    if data_type == "string":
        number = F.try_to_number(c, F.lit("9999999999999999")).cast("long")
        return F.coalesce(_from_epoch(number), c.try_cast("timestamp"))
    return _from_epoch(c.try_cast("double"))


def _from_epoch(n: Column) -> Column:
    return F.when(n > F.lit(1e11), F.timestamp_millis(n.cast("long"))).otherwise(
        F.timestamp_seconds(n.cast("double")))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def cents(c: Column) -> Column:
    """Half-up to two decimals in plain double arithmetic."""
    return F.floor(c * 100.0 + 0.5) / F.lit(100.0)
