"""Price reaction: first moves, their order over instruments, jump sizes, lead and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import Study
from tidegrid.operators.stats import curve_intervals, event_intervals, nearest_quantile
from tidegrid.schema import KEYS

EVENT = ["window_id", "event_type", "stage", "instrument"]


def _changes(panel: DataFrame, name: str) -> DataFrame:
    return panel.withColumn(name, F.col("mid") - F.lag("mid").over(Window.partitionBy(*KEYS).orderBy("offset_ms")))


def thresholds(fine: DataFrame, q: float, least: float = 0.5) -> DataFrame:
    """k_ticks per instrument: the q-quantile (nearest rank) of the size of mid changes on control days, at least half a tick."""
    moves = _changes(fine.filter("event_type = 'CONTROL'"), "d").withColumn("abs_move", F.abs("d"))
    out = nearest_quantile(moves, ["instrument"], "abs_move", q)
    return out.select("instrument", F.greatest(F.col("quantile"), F.lit(least)).alias("k_ticks"), F.col("n").alias("control_steps"))


def first_moves(moves: DataFrame, k: DataFrame) -> DataFrame:
    """Per event stage and instrument the first move after t0 beyond the threshold: ms and ticks, NULL where there is none."""
    d = moves.filter((F.col("event_type") != "CONTROL") & (F.col("offset_ns") >= 0)).join(k, "instrument")
    beyond = F.abs("mid_move") > F.col("k_ticks")
    return d.groupBy(*EVENT).agg(
        (F.min(F.when(beyond, F.col("offset_ns"))) / 1e6).alias("first_move_ms"), F.min_by("mid_move", F.when(beyond, F.col("offset_ns"))).alias("first_move_ticks")
    )


def leads(first: DataFrame, reference: str) -> DataFrame:
    """First moves with lead_ms, the time after the reference instrument's own first move in that window and stage."""
    ref = F.max(F.when(F.col("instrument") == reference, F.col("first_move_ms"))).over(Window.partitionBy("window_id", "event_type", "stage"))
    return first.withColumn("lead_ms", F.col("first_move_ms") - ref)


def ranking(first: DataFrame, study: Study) -> DataFrame:
    """Per event type, stage and instrument the median first move and the median time after the reference, with intervals."""
    key = ["event_type", "stage", "instrument"]
    d = leads(first, study.reference)
    own = event_intervals(d, key, "window_id", "first_move_ms", study.reps, study.seed + 1)
    paired = event_intervals(d, key, "window_id", "lead_ms", study.reps, study.seed + 1)
    own = own.select(*key, F.col("n").alias("events_with_move"), F.col("estimate").alias("median_first_move_ms"), "lo", "hi")
    paired = paired.select(*key, F.col("estimate").alias("median_minus_ref_ms"), F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi"), F.col("n").alias("paired_events"))
    return d.groupBy(*key).agg(F.count("*").alias("events")).join(own, key).join(paired, key)


def jump_sizes(coarse: DataFrame, study: Study) -> DataFrame:
    """Size of the mid move at each horizon on the grid, in ticks and in units of the volatility before the release."""
    lo, hi = study.baseline_s
    last = coarse.filter(F.col("offset_ms").between(lo * 1000, (hi - study.coarse.step_ms / 1000) * 1000))
    vol = _changes(last, "d").groupBy("window_id", "stage", "instrument").agg(F.stddev_samp("d").alias("vol_1s"))
    at = coarse.filter(F.col("offset_ms").isin([h * 1000 for h in study.horizons_s])).join(vol, ["window_id", "stage", "instrument"], "left")
    steps = F.sqrt(F.col("offset_ms") / study.coarse.step_ms)
    return at.select(
        *EVENT, F.floor(F.col("offset_ms") / 1000).alias("horizon_s"), "mid_move", F.abs("mid_move").alias("abs_move_ticks"), "vol_1s",
        F.try_divide(F.abs("mid_move"), F.col("vol_1s") * steps).alias("abs_move_vol"),
    )


def jump_summary(jumps: DataFrame) -> DataFrame:
    return jumps.groupBy("event_type", "stage", "instrument", "horizon_s").agg(
        F.count("*").alias("events"), F.median("abs_move_ticks").alias("median_abs_move_ticks"), F.median("abs_move_vol").alias("median_abs_move_vol_units")
    )


def lagged_correlations(fine: DataFrame, study: Study) -> DataFrame:
    """Per event, instrument and lag the correlation of the reference's return with the instrument's return `lag` steps later.

    Returns are taken on the whole series before it is cut to the window, so the move into t0 counts. The lag is an equi-join
    on shifted offsets. Fewer than five pairs, or no variation, give NULL.
    """
    step = study.fine.step_ms
    rets = _changes(fine.filter("event_type <> 'CONTROL'"), "ret").filter(F.col("offset_ms").between(0, study.lag_window_s * 1000)).filter("ret is not null")
    ref = rets.filter(F.col("instrument") == study.reference).select("window_id", "stage", F.col("ret").alias("x"), "offset_ms")
    lags = F.explode(F.sequence(F.lit(-study.lag_steps), F.lit(study.lag_steps))).alias("lag")
    ref = ref.select("window_id", "stage", "x", "offset_ms", lags).select("window_id", "stage", "x", "lag", (F.col("offset_ms") + F.col("lag") * step).alias("offset_ms"))
    pairs = rets.filter(F.col("instrument") != study.reference).join(ref, ["window_id", "stage", "offset_ms"])
    stat = pairs.groupBy(*EVENT, "lag").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("x", "ret"), F.stddev_samp("x") * F.stddev_samp("ret")).alias("c"), (F.max("x") > F.min("x")).alias("vx"), (F.max("ret") > F.min("ret")).alias("vy"))
    return stat.select(*EVENT, (F.col("lag") * step).cast("int").alias("lag_ms"), F.when((F.col("n") >= 5) & F.col("vx") & F.col("vy"), F.col("c")).alias("corr"))


def lead_lag(fine: DataFrame, study: Study) -> DataFrame:
    """The correlations averaged over events with a band; stages of one event type are pooled as events of their own."""
    per_event = lagged_correlations(fine, study).withColumn("event", F.concat_ws("/", "window_id", "stage"))
    out = curve_intervals(per_event, ["event_type", "instrument"], "event", "lag_ms", "corr", study.reps, study.seed + 1)
    return out.withColumnRenamed("mean", "corr").withColumnRenamed("n_events", "events")
