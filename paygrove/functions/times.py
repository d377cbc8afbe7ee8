"""Instants as microseconds since 1970, UTC; local clocks and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def step_instant(step: Column, epoch_us: int, offset_us: Column) -> Column:
    """A period index to an instant: hours since the epoch, plus an offset within the hour."""
    return F.lit(epoch_us) + step * F.lit(HOUR_US) + offset_us


def from_local(clock: Column, zone: str, shape: str = "yyyy/MM/dd HH:mm") -> Column:
    """A naive local clock to microseconds UTC; null where the text isn't a real time."""
    return F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(clock, F.lit(shape)), zone))


def local_hour(us: Column, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def local_date(us: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), zone))
