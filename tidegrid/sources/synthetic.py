"""Synthetic books around releases with planted effects, for tests and demonstrations.

Every draw is a hash of (seed, window, instrument, slot), so a tick is the same however the work is partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NS = 10**9


@dataclass(frozen=True)
class Planted:
    """What the books show: depth falls `drop` before t0 from `lead_s` on and recovers, spreads widen and activity rises after the move."""

    lead_s: float = 20.0
    drop: float = 0.8
    depth_half_life_s: float = 30.0
    extra_ticks: int = 6
    spread_half_life_s: float = 4.0
    activity: float = 8.0
    activity_half_life_s: float = 40.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**52)) / F.lit(float(2**52))


def books(spark: SparkSession, events: DataFrame, instruments: DataFrame, start_s: int, end_s: int, seed: int = 1, levels: int = 10, planted: Planted = Planted()) -> DataFrame:
    """Canonical frames of all windows (window_id, t0_ns, z, effect) and instruments (instrument, rate, start_price, base_depth, trade_share, vol, jump, lag_ms).

    z is the surprise: the mid moves by round(jump * z) at t0 + lag. effect: False for control windows, which show nothing.
    Updates come at `rate` a second on average, more after the move; prices walk by whole ticks.
    """
    p = planted
    # A window of several stages reacts to the first.
    events = events.groupBy("window_id").agg(F.min_by(F.struct("t0_ns", "z", "effect"), "t0_ns").alias("e")).select("window_id", "e.*")
    top = F.ceil(F.col("rate") * F.when(F.col("effect"), p.activity).otherwise(1.0))
    seconds = events.join(F.broadcast(instruments)).select("*", F.explode(F.sequence(F.lit(start_s), F.lit(end_s - 1))).alias("sec"))
    slots = seconds.select("*", F.explode(F.sequence(F.lit(0), (top - 1).cast("int"))).alias("slot"), top.alias("top"))
    key = [F.col(c) for c in ("window_id", "instrument", "sec", "slot")]
    slots = slots.withColumn("off_ns", (F.col("sec").cast("long") * NS + (F.col("slot") + uniform(seed, *key, F.lit("t"))) * NS / F.col("top")).cast("long"))
    after = F.col("off_ns") / NS - F.col("lag_ms") / 1000
    live = F.col("effect") & (after >= 0)
    boost = F.when(live, 1 + (p.activity - 1) * F.pow(F.lit(2.0), -after / p.activity_half_life_s)).otherwise(1.0)
    t = slots.filter(uniform(seed, *key, F.lit("keep")) < F.col("rate") * boost / F.col("top"))
    step = F.when(uniform(seed, *key, F.lit("step")) < F.col("vol") / F.col("rate"), F.when(uniform(seed, *key, F.lit("way")) < 0.5, -1).otherwise(1)).otherwise(0)
    w = Window.partitionBy("window_id", "instrument").orderBy("off_ns", "slot").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"walk": F.sum(step).over(w), "n": F.row_number().over(w)})
    jump = F.when(live, F.rint(F.col("jump") * F.col("z"))).otherwise(0)
    mid = F.col("start_price") + F.col("walk") + jump
    wide = F.when(live, F.rint(p.extra_ticks / 2 * F.pow(F.lit(2.0), -after / p.spread_half_life_s))).otherwise(0)
    s = F.col("off_ns") / NS
    factor = F.when(~F.col("effect") | (s < -p.lead_s), 1.0).when(s < 0, 1 - p.drop * (s + p.lead_s) / p.lead_s).otherwise(1 - p.drop * F.pow(F.lit(2.0), -s / p.depth_half_life_s))
    size = [(side, i, F.greatest(F.lit(1), F.rint(F.col("base_depth") * (1 + i * 0.3) * factor * (0.9 + 0.2 * uniform(seed, *key, F.lit(f"{side}{i}")))))) for i in range(levels) for side in ("bid", "ask")]
    traded = uniform(seed, *key, F.lit("trade")) < F.col("trade_share")
    side = F.when(uniform(seed, *key, F.lit("side")) < 0.5, 1).otherwise(-1)
    touch = [e.cast("long").alias(n) for i in range(levels) for n, e in ((f"bid_px_{i}", mid - wide - i), (f"ask_px_{i}", mid + 1 + wide + i))]
    return t.select(
        "window_id", "instrument", F.col("n").cast("long").alias("seq"), (F.col("t0_ns") + F.col("off_ns")).alias("ts_event"), F.when(traded, 3).otherwise(2).alias("action"), side.alias("side"),
        mid.cast("long").alias("price"), (1 + F.floor(9 * uniform(seed, *key, F.lit("size")))).cast("long").alias("size"), *touch, *[e.cast("long").alias(f"{sd}_sz_{i}") for sd, i, e in size],
    )


def study_calendar(spark: SparkSession, per_type: int, controls: int, first: str = "2025-01-06", seed: int = 1, fomc: int = 0) -> DataFrame:
    """Weekly releases (CPI on Wednesdays, NFP on Fridays), meetings every third Wednesday, controls on Tuesdays at 08:30 and, if there are
    meetings, on Thursdays at 14:00: window_id, event_type, stage, time_et, t0_ns, z, effect. A meeting has two stages, and so has a control at its time."""
    from tidegrid.functions.clock import et_to_utc_ns

    one, two = [("release", "08:30")], [("statement", "14:00"), ("press_conference", "14:30")]
    plan = [("CPI", 2, 1, per_type, one), ("NFP", 4, 1, per_type, one), ("CONTROL", 1, 1, controls, [("control", "08:30")])]
    plan += [("FOMC", 2, 3, fomc, two), ("CONTROL", 3, 1, controls, [("control", "14:00"), ("control_1430", "14:30")])] if fomc else []
    kinds = "event_type string, weekday int, every int, n int, stages array<struct<stage: string, time_et: string>>"
    rows = spark.createDataFrame([p for p in plan if p[3] > 0], kinds).select("event_type", "weekday", "every", "stages", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("week"))
    d = rows.withColumn("day", F.date_add(F.lit(first).cast("date"), F.col("week") * 7 * F.col("every") + F.col("weekday"))).select("*", F.explode("stages").alias("s")).select("event_type", "week", "day", "s.*")
    control = F.col("event_type") == "CONTROL"
    z = F.round((uniform(seed, F.col("event_type"), F.col("week")) - 0.5) * 4, 2)
    return d.select(F.concat_ws("_", "event_type", F.date_format("day", "yyyy-MM-dd")).alias("window_id"), "event_type", "stage", "time_et", et_to_utc_ns(F.col("day"), F.col("time_et")).alias("t0_ns"), F.when(control, 0.0).otherwise(z).alias("z"), (~control).alias("effect"))
