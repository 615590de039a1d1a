"""Date and time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_to_local(c, tz: str = "UTC") -> Column:
    """Epoch microseconds -> wall-clock ``timestamp_ntz`` in zone ``tz``.

    Pure arithmetic on ``timestamp_ntz`` plus an explicit zone conversion, so
    the result does not depend on the session time zone.
    """
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    utc = F.timestamp_add("MICROSECOND", _c(c), epoch)
    if tz.upper() == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def micros_to_date(c, tz: str = "UTC") -> Column:
    """Epoch microseconds -> ``yyyy-MM-dd`` string in zone ``tz``."""
    return F.date_format(micros_to_local(c, tz), "yyyy-MM-dd")


def ntz_to_micros(c) -> Column:
    """``timestamp_ntz`` (read as UTC wall time) -> epoch microseconds."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, _c(c))


def month_of(date_str) -> Column:
    """``yyyy-MM`` prefix of a ``yyyy-MM-dd`` string."""
    return F.left(_c(date_str), F.lit(7))


def year_of(date_str) -> Column:
    """Year of a ``yyyy-MM-dd`` string as INT."""
    return F.left(_c(date_str), F.lit(4)).try_cast("int")
