"""Liquidity around releases: depth against its baseline, spreads, activity, withdrawal and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import Study
from tidegrid.functions.clock import control_group, group_label
from tidegrid.operators.stats import event_intervals, median_of

SERIES = ["window_id", "stage", "group", "instrument"]
METRICS = ["withdrawal_start_s", "min_depth_pct", "max_spread_first_min", "recovery_50_s", "recovery_90_s", "spread_recovery_s"]


def with_baselines(coarse: DataFrame, base: DataFrame) -> DataFrame:
    """The coarse panel with its baselines, depth_pct (100 depth_1 / baseline) and the group's label."""
    b = base.select("window_id", "event_type", "stage", "instrument", "base_depth_1", "base_spread")
    joined = coarse.join(b, ["window_id", "event_type", "stage", "instrument"], "left")
    return joined.withColumns({
        "depth_pct": F.try_divide(100.0 * F.col("depth_1"), F.col("base_depth_1")),
        "group": group_label(F.col("event_type"), F.col("stage"), F.col("time_et")),
    })


def curve_points(panel: DataFrame, span_s: tuple[int, int], skip_missing_spread: bool = False) -> DataFrame:
    """Long form of the four measures of a curve: series, offset_s, measure, value. A missing spread counts as not wide unless skipped."""
    wide = F.col("spread") > 1
    wide = wide.cast("double") if skip_missing_spread else F.coalesce(wide, F.lit(False)).cast("double")
    inside = panel.filter(F.col("offset_ms").between(span_s[0] * 1000, span_s[1] * 1000)).withColumn("wide_spread", wide)
    measures = {"depth_pct": "depth_pct", "wide_spread": "wide_spread", "updates_per_s": "updates", "trades_per_s": "trades"}
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("value")) for m, c in measures.items()])
    return inside.select(*SERIES, F.expr("offset_ms div 1000").alias("offset_s"), F.explode(rows).alias("m")).select(*SERIES, "offset_s", "m.*")


def curves(points: DataFrame) -> DataFrame:
    """Mean over events per group, instrument, measure and offset; n_events counts the events of the curve, n_nonnull those with a value."""
    key = ["group", "instrument", "measure"]
    events = points.select(*key, "window_id").distinct().groupBy(*key).agg(F.count("*").alias("n_events"))
    means = points.groupBy(*key, "offset_s").agg(F.avg("value").alias("mean"), F.count("value").alias("n_nonnull"))
    return means.join(events, key)


def smoothed(panel: DataFrame, column: str, width: int = 5) -> Column:
    """Centred rolling median over the series' grid; beyond an end the end value stands in, NULLs are skipped."""
    w = Window.partitionBy(*SERIES).orderBy("offset_ms")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(w), F.count("*").over(whole)
    parts = [F.col(column)]
    for k in range(1, width // 2 + 1):
        parts.append(F.when(at > k, F.lag(column, k).over(w)).otherwise(F.first(column).over(whole)))
    for k in range(1, width - width // 2):
        parts.append(F.when(at <= n - k, F.lead(column, k).over(w)).otherwise(F.last(column).over(whole)))
    return median_of(F.array(*parts))


def held(condition: Column, points: int) -> Column:
    """The condition holds here and at the next points - 1 of the series; False where fewer remain."""
    w = Window.partitionBy(*SERIES).orderBy("offset_ms").rowsBetween(0, points - 1)
    return F.sum(F.coalesce(condition, F.lit(False)).cast("int")).over(w) >= points


def event_metrics(panel: DataFrame, study: Study) -> DataFrame:
    """Per series: least smoothed depth around t0, widest spread in the first minute, seconds to recovered and held levels."""
    p = panel.withColumn("smooth", smoothed(panel, "depth_pct", study.smooth))
    flags = {f"ok_{round(v * 100)}": held(F.col("smooth") >= 100 * v, study.hold) for v in study.recovery_levels}
    p = p.withColumns({**flags, "ok_spread": held(F.col("spread") <= F.col("base_spread") + 1e-9, study.hold)})
    s = F.col("offset_ms") / 1000

    def within(span: tuple[int, int]) -> Column:
        return s.between(*span)

    def first(flag: str) -> Column:
        return F.min(F.when(F.col(flag) & (s >= 0), s))

    return p.groupBy(*SERIES).agg(
        F.min(F.when(within(study.around_s), F.col("smooth"))).alias("min_depth_pct"), F.max(F.when(within(study.first_minute_s), F.col("spread"))).cast("double").alias("max_spread_first_min"),
        *[first(f).alias(f"recovery_{f[3:]}_s") for f in flags], first("ok_spread").alias("spread_recovery_s"),
    )


def withdrawal_starts(panel: DataFrame, study: Study) -> DataFrame:
    """Per series the offset (s) at which depth begins to fall before t0, NULL if it doesn't: SERIES, withdrawal_start_s.

    Within the search span the smoothed depth is fitted by two joined straight pieces, each through the value before it and
    its own last one; the break of least squared error counts if the median before it lies at least least_drop_pct above the
    median of the last points. NULL depths are left out; fewer than three segments of points give NULL. A series is as long
    as the grid, so it is searched as one array.
    """
    k, width = study.segment, study.smooth
    inside = panel.filter(F.col("offset_ms").between(study.search_s[0] * 1000, study.search_s[1] * 1000))
    arrays = inside.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.when(F.col("depth_pct").isNotNull(), F.struct(F.col("offset_ms").alias("x"), F.col("depth_pct").alias("y"))))).alias("a"))
    n = F.size("a")
    arrays = arrays.withColumn("n", n)
    half = width // 2

    def at(i: Column) -> Column:
        return F.get("a", F.greatest(F.lit(0), F.least(i, F.col("n") - 1)).cast("int"))["y"]

    smooth = F.transform("a", lambda _, i: median_of(F.array(*[at(i + d) for d in range(-half, width - half)])))
    arrays = arrays.filter(F.col("n") >= 3 * k).withColumn("y", smooth)

    def error(start: Column, end: Column) -> Column:
        """Squared distance of y[start:end] from the line through y[start - 1] and y[end - 1]."""
        first = F.get("y", (start - 1).cast("int"))
        slope = (F.get("y", (end - 1).cast("int")) - first) / (end - start)
        return F.aggregate(F.sequence(start, end - 1), F.lit(0.0), lambda s, i: s + F.pow(F.get("y", i.cast("int")) - first - slope * (i - start + 1), 2))

    cost = F.transform(F.sequence(F.lit(k), F.col("n") - k), lambda b: F.struct(F.round(error(F.lit(1), b) + error(b, F.col("n")), 9).alias("cost"), b.alias("b")))
    arrays = arrays.withColumn("b", F.array_min(cost)["b"])
    before, after = median_of(F.slice("y", F.lit(1), F.col("b"))), median_of(F.slice("y", F.col("n") - k + 1, F.lit(k)))
    found = arrays.select(*SERIES, F.when(before - after >= study.least_drop_pct, F.get("a", F.col("b").cast("int"))["x"] / 1000).alias("withdrawal_start_s"))
    return panel.select(*SERIES).distinct().join(found, SERIES, "left")


def summary(events: DataFrame, metrics: list[str], study: Study) -> DataFrame:
    """Per group, instrument and metric the median over events with its interval, long form: metric, estimate, lo, hi, n."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = events.select("group", "instrument", "window_id", F.explode(rows).alias("m")).select("group", "instrument", "window_id", "m.*")
    return event_intervals(long, ["group", "instrument", "metric"], "window_id", "value", study.reps, study.seed)


def against_controls(summary_rows: DataFrame) -> DataFrame:
    """Each event group's summary next to that of the control group at the same clock time."""
    control = summary_rows.select(F.col("group").alias("control_group"), "instrument", "metric", F.col("estimate").alias("control_estimate"), F.col("n").alias("n_control"))
    events = summary_rows.withColumn("control_group", control_group(F.col("group"))).filter("control_group is not null")
    return events.join(control, ["control_group", "instrument", "metric"], "left")
