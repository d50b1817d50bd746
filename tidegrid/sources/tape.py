"""The demonstration tape: the events table read as an order book of ten levels, and its calendar of stages.

Whole numbers only, so that any engine derives the same book: an instrument is an event type, a window a UTC day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.clock import et_to_utc_ns
from tidegrid.sources.tables import table

LEVELS = 10
#: By ISO weekday the stages of a day (event type, stage, Eastern time).
WEEK = {
    1: [("CPI", "release", "08:30")], 2: [("NFP", "release", "08:30")], 3: [("CPI", "release", "08:30")],
    4: [("FOMC", "statement", "14:00"), ("FOMC", "press_conference", "14:30")], 5: [("NFP", "release", "08:30")],
    6: [("CONTROL", "control", "08:30"), ("CONTROL", "control_1400", "14:00"), ("CONTROL", "control_1430", "14:30")],
    7: [("CONTROL", "control", "08:30"), ("CONTROL", "control_1400", "14:00"), ("CONTROL", "control_1430", "14:30")],
}


def window_of(day: Column) -> Column:
    return F.concat(F.lit("D"), F.date_format(day, "yyyy-MM-dd"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The book frame of the tape; one side is missing where the key is a multiple of 17."""
    e = table(spark, folder, "events").select("event_id", "ts", "event_type", "value", "props")
    e = e.withColumn("kk", F.get_json_object("props", "$.k").cast("long")).withColumn("p", 10_000 + F.rint(F.col("value") * 100).cast("long"))
    h, one_sided = 1 + F.col("kk") % 3, F.col("kk") % 17 == 0
    book = [
        c
        for i in range(LEVELS)
        for c in (
            (F.col("p") - h - i).alias(f"bid_px_{i}"), F.when(~one_sided, F.col("p") + h + i).alias(f"ask_px_{i}"),
            (1 + (F.col("kk") * (i + 1)) % 40).alias(f"bid_sz_{i}"), (1 + (F.col("kk") * (i + 3)) % 40).alias(f"ask_sz_{i}"),
        )
    ]
    return e.select(
        window_of(F.col("ts")).alias("window_id"), F.col("event_type").alias("instrument"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_event"), F.when(F.col("kk") % 4 == 0, 3).otherwise(2).alias("action"),
        (F.col("kk") % 3 - 1).alias("side"), F.col("p").alias("price"), (1 + F.col("kk") % 7).alias("size"), *book,
    )


def days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("ts").cast("date").alias("day")).distinct()


def stages(spark: SparkSession, folder: str) -> DataFrame:
    """Stages (window_id, event_type, stage, time_et, day, t0_ns) of the days of the tape."""
    isodow = F.weekday("day") + 1
    of_day = F.lit(None)
    for d, rows in WEEK.items():
        of_day = F.when(isodow == d, F.array(*[F.struct(F.lit(t).alias("event_type"), F.lit(s).alias("stage"), F.lit(e).alias("time_et")) for t, s, e in rows])).otherwise(of_day)
    rows = days(spark, folder).select("day", F.explode(of_day).alias("s")).select("day", "s.*")
    return rows.select(window_of(F.col("day")).alias("window_id"), "event_type", "stage", "time_et", "day", et_to_utc_ns(F.col("day"), F.col("time_et")).alias("t0_ns"))


def surprises(spark: SparkSession, folder: str) -> DataFrame:
    """One whole-number surprise per CPI and NFP day: the turnover of the day before less that of the day before that."""
    turnover = ticks(spark, folder).groupBy(F.to_date(F.substring("window_id", 2, 10)).alias("day")).agg(F.sum("price").alias("turnover"))
    shifted = [turnover.select(F.date_add("day", k).alias("day"), F.col("turnover").alias(f"t{k}")) for k in (1, 2)]
    releases = stages(spark, folder).filter(F.col("event_type").isin("CPI", "NFP")).select("window_id", "event_type", "day")
    rows = releases.join(shifted[0], "day").join(shifted[1], "day")
    return rows.select(F.col("window_id").alias("event_id"), "event_type", F.col("day").alias("release_date"), (F.col("t1") - F.col("t2")).alias("surprise"))
