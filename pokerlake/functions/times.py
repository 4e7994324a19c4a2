"""Time buckets and capture times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: capture files carry their time of day in the name.
CAPTURE_NAME = r"screenshot_(\d{8}_\d{6})"


def bucket_number(seconds: Column, width: int) -> Column:
    """Index of the fixed-width interval that holds a time given in seconds."""
    return F.floor(seconds / F.lit(width)).cast("bigint")


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width interval that holds ``ts``."""
    return F.timestamp_seconds(bucket_number(F.unix_timestamp(ts), seconds) * seconds)


def capture_time(file_name: Column) -> Column:
    """Time from a capture file name; NULL when the name carries none."""
    stamp = F.nullif(F.regexp_extract(file_name, CAPTURE_NAME, 1), F.lit(""))
    return F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
