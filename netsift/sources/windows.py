"""Which days a job looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_existing_days(df: DataFrame, n: int, day: str = "day") -> DataFrame:
    """The last ``n`` days that have data, numbered 0 (oldest) .. n-1.

    On a table partitioned by day this reads partition values only. The result has at most ``n``
    rows by its limit, so it is safe to broadcast: flows are never shuffled by day.
    """
    days = df.select(day).distinct().orderBy(F.desc(day)).limit(n)
    listed = F.sort_array(F.collect_list(day))
    return F.broadcast(days.agg(listed.alias("_days")).select(F.posexplode("_days").alias("day_no", day)))


def in_last_existing_days(df: DataFrame, n: int | None, day: str = "day", of: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``n`` days that have data (in ``of``, or in the rows themselves); all rows without ``n``."""
    if n is None:
        return df
    return df.join(last_existing_days(df if of is None else of, n, day).select(day), day)


def in_calendar_window(df: DataFrame, days: int, today, day: str = "day") -> DataFrame:
    """Rows of the ``days`` calendar days that end with ``today`` (a pruning partition filter)."""
    today = F.lit(today).cast("date")
    return df.where((F.col(day) > F.date_sub(today, days)) & (F.col(day) <= today))
