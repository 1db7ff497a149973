"""Time formatting and date locations (O-36, O-37)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the result time format, %Y/%m/%d %H:%I:%S — note %I (12-hour hour)
# where minutes would be expected; reproduced as is.
RESULT_TIME_FORMAT = "yyyy/MM/dd HH:hh:ss"


def print_time(ts: Column) -> Column:
    """O-36: a timestamp in the result format; a missing time means now."""
    return F.date_format(F.coalesce(ts, F.current_timestamp()), RESULT_TIME_FORMAT)


def print_time_any(value: Column, dtype: str) -> Column:
    """O-36 for any column type: strings pass through, timestamps are formatted,
    anything else gives ''."""
    if dtype == "string":
        return value
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return print_time(value.cast("timestamp"))
    return F.when(value.isNull(), print_time(F.lit(None).cast("timestamp"))).otherwise(F.lit(""))


def storage_partition(ts: Column, root: str = "results") -> list[Column]:
    """O-37: ``year, month, day`` partition columns and the ``ROOT/YYYY/MM/DD`` location."""
    t = F.coalesce(ts, F.current_timestamp())
    return [
        F.year(t).alias("year"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day"),
        F.concat(F.lit(root.rstrip("/") + "/"), F.date_format(t, "yyyy/MM/dd")).alias("location"),
    ]
