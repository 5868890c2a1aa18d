"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of 2000-01-01 UTC; a station clock that was never set reads earlier.
CLOCK_SET_US = 946_684_800_000_000
MICROS = 1_000_000


def aircraft(icao: Column) -> Column:
    """Upper case without outer spaces; null where nothing is left."""
    name = F.upper(F.trim(icao))
    return F.when(name != "", name)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def floor_to(us: Column, width_us: int) -> Column:
    """The start of the period of width_us that holds us, also before 1970."""
    return us - F.pmod(us, F.lit(width_us))


def bucket(us: Column, width_us: int) -> Column:
    """The number of the period of width_us that holds us, in whole numbers, also before 1970."""
    return F.call_function("div", us - F.pmod(us, F.lit(width_us)), F.lit(width_us))
