"""Time columns: epoch seconds, half-open windows and calendar buckets.

Ledger timestamps are integer epoch seconds. Buckets are rendered with
``date_format`` in the session time zone unless ``tz`` names another zone,
in which case the wall clock is converted explicitly so the result does not
depend on the session setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The original study's windows, epoch seconds. The year runs
# 2020-09-01 to 2021-09-01 and the "last month" 2021-08-01 to 2021-09-01,
# midnights at UTC+8.
STUDY_YEAR = (1598889600, 1630425600)
STUDY_LAST_MONTH = (1627747200, 1630425600)

# Fixed bucket formats (Spark datetime patterns) of the trend reports.
BUCKET_FORMATS = {
    "day": "yyyy-MM-dd",
    "hour": "yyyy-MM-dd HH",
    "month": "yyyy-MM",
    "hour_of_day": "HH",
    "time_of_day": "HH:mm:ss",
    "datetime": "yyyy-MM-dd HH:mm:ss",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_timestamp(c: Column | str) -> Column:
    """Epoch seconds -> TIMESTAMP (an instant; rendered in the session zone)."""
    return F.timestamp_seconds(_col(c))


def wall_clock(c: Column | str, tz: str | None = None) -> Column:
    """Epoch seconds -> a timestamp whose rendering is the wall clock in ``tz``.

    With ``tz=None`` this is the instant itself (session zone rendering).
    Otherwise the UTC wall clock is built as a zone-free TIMESTAMP_NTZ by
    adding the seconds to the epoch, then converted from UTC to ``tz``: the
    session zone never takes part, so a session zone with daylight saving
    cannot make an hour ambiguous.
    """
    if tz is None:
        return epoch_to_timestamp(c)
    epoch = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
    utc = F.timestamp_add("SECOND", _col(c), epoch)
    if tz.upper() in ("UTC", "Z", "+00:00", "ETC/UTC"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def bucket(c: Column | str, unit: str, tz: str | None = None) -> Column:
    """Format epoch seconds as a day / hour / month / hour-of-day bucket."""
    try:
        fmt = BUCKET_FORMATS[unit]
    except KeyError:
        raise ValueError(f"unknown bucket unit {unit!r}; one of {sorted(BUCKET_FORMATS)}")
    return F.date_format(wall_clock(c, tz), fmt)


def in_window(c: Column | str, start: int | None = None, end: int | None = None) -> Column:
    """Half-open time window ``start <= c < end``; either bound may be open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (_col(c) >= F.lit(start))
    if end is not None:
        cond = cond & (_col(c) < F.lit(end))
    return cond


def timestamp_to_epoch(df: DataFrame, name: str) -> Column:
    """Epoch seconds of a TIMESTAMP or TIMESTAMP_NTZ column of ``df``.

    A TIMESTAMP_NTZ is read as a UTC wall clock, independent of the session
    zone: whole days since the epoch plus the time of day.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        parts = (F.unix_date(c.cast(T.DateType())).cast("long") * 86400
                 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long")
        # from 1970 on one division; before it that would round fractions up
        since = c >= F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
        return F.when(since, F.to_unix_timestamp(c)).otherwise(parts)
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long") * 86400
    return c.cast("long")
