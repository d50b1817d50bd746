"""Clock arithmetic: Eastern time to UTC nanoseconds and back, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def et_to_utc_ns(day: Column, time_et: Column, zone: str = ZONE) -> Column:
    """Nanoseconds of a date and HH:MM in `zone`, right across daylight saving changes. NULL or malformed times give NULL."""
    minutes = F.split_part(time_et, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(time_et, F.lit(":"), F.lit(2)).try_cast("int")
    local = F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000 + minutes.cast("long") * 60_000_000)
    return F.unix_micros(F.to_utc_timestamp(local, zone)) * 1000


def utc_ns_to_et(ns: Column, zone: str = ZONE) -> Column:
    """The wall clock in `zone` of UTC nanoseconds, to the microsecond."""
    return F.from_utc_timestamp(F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("long"))), zone)


def group_label(event_type: Column, stage: Column, time_et: Column) -> Column:
    """"CONTROL 08:30" for controls, else the event type and its stage in words."""
    return F.when(event_type == "CONTROL", F.concat(F.lit("CONTROL "), time_et)).otherwise(F.concat_ws(" ", event_type, F.translate(stage, "_", " ")))


def control_group(label: Column) -> Column:
    """The control group at the same clock time as an event group; NULL for others."""
    same = {"CPI release": "08:30", "NFP release": "08:30", "FOMC statement": "14:00", "FOMC press conference": "14:30"}
    pairs = [F.lit(x) for k, v in same.items() for x in (k, f"CONTROL {v}")]
    return F.create_map(*pairs)[label]
