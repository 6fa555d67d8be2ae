"""Calendar helpers (F1-F3): whole days, period start, period difference."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

PERIOD_UNITS = {"D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER"}


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_days(later, earlier) -> Column:
    """Floor of elapsed 24-hour days from ``earlier`` to ``later``.

    This is not ``datediff`` (calendar dates): 2024-01-02 01:00 minus
    2024-01-01 23:00 is 0 whole days here, 1 for ``datediff``.
    """
    micros = F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("long")


def check_period(period: str) -> str:
    if period not in PERIOD_UNITS:
        raise ValueError("period must be one of D/W/M/Q")
    return PERIOD_UNITS[period]


def period_start(c, period: str) -> Column:
    """First day of the D/W/M/Q period holding ``c`` (weeks start Monday)."""
    unit = check_period(period)
    return F.date_trunc(unit, as_col(c)).cast("date")


def period_diff(later_start, earlier_start, period: str) -> Column:
    """Whole periods between two period starts (both from ``period_start``)."""
    check_period(period)
    a, b = as_col(later_start), as_col(earlier_start)
    if period == "D":
        return F.datediff(a, b).cast("long")
    if period == "W":
        return (F.datediff(a, b) / 7).cast("long")
    if period == "M":
        return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("long")
    return ((F.year(a) - F.year(b)) * 4 + (F.quarter(a) - F.quarter(b))).cast("long")


def as_timestamp(df, col: str) -> Column:
    """The column as a timestamp without changing its kind: TIMESTAMP_NTZ
    stays NTZ (so day arithmetic does not depend on the session time zone),
    TIMESTAMP stays as is, anything else is parsed with ``to_timestamp``."""
    from pyspark.sql.types import TimestampNTZType, TimestampType
    dt = df.schema[col].dataType
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return F.col(col)
    return F.to_timestamp(F.col(col))


def literal_like(df, col: str, value) -> Column:
    """A reference date literal of the same timestamp kind as ``col``."""
    from pyspark.sql.types import TimestampNTZType
    kind = "timestamp_ntz" if isinstance(df.schema[col].dataType, TimestampNTZType) else "timestamp"
    return F.lit(value).cast(kind)
