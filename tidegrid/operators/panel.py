"""Event-time panels: a tick frame seen on a grid around every stage, without an as-of join.

Ticks collapse by hash to the last state, counts and sums per grid cell before the shuffle. Each occupied cell then states the
points up to the next one, so nothing but the collapsed cells is sorted, and a hot instrument costs no more than its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import PIECE
from tidegrid.functions.previous import with_previous
from tidegrid.operators.counter_grid import Grid, cell_of, moment
from tidegrid.schema import BID, DEPTH_LEVELS, FILL, KEYS, TRADE, levels_of

BASELINE_MEASURES = ["spread", "depth_1", "depth_3", "depth_5", "depth_10", "updates", "trades", "volume"]


def touch_mid() -> Column:
    """(bid + ask) / 2 where both stand."""
    return (F.col("bid_px_0") + F.col("ask_px_0")) / 2.0


def depth(k: int, levels: int) -> Column:
    """Sizes of the first k levels of both sides; NULL beyond the levels of the source."""
    if k > levels:
        return F.lit(None).cast("long")
    out = F.col("bid_sz_0") + F.col("ask_sz_0")
    for i in range(1, k):
        out = out + F.col(f"bid_sz_{i}") + F.col(f"ask_sz_{i}")
    return out


def is_trade() -> Column:
    return F.col("action").isin(TRADE, FILL)


def signed() -> Column:
    """+1 for the bid's side, -1 for any other."""
    return F.when(F.col("side") == BID, 1).otherwise(-1)


def staged(ticks: DataFrame, stages: DataFrame, on: list[str]) -> DataFrame:
    """Ticks with the stages of their window and the offset from each t0; a tick or stage without a time has none."""
    s = stages.select("window_id", "event_type", "stage", "time_et", "t0_ns")
    return ticks.join(s, on).withColumn("off", F.col("ts_event") - F.col("t0_ns")).filter("off is not null")


def _points(cells: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """One row per series and grid point from its occupied cells: j, r (the state of the last cell, or NULL), here (the cell is j)."""
    w = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.select("*", F.lead("cell").over(w).alias("next"), F.lag("cell").over(w).isNull().alias("leads"))
    low = F.when(F.col("leads"), 0).otherwise(F.col("cell"))
    high = F.coalesce(F.col("next"), F.lit(grid.points)) - 1
    points = cells.filter(low <= high).withColumn("j", F.explode(F.sequence(low, high)))
    return points.withColumns({"here": F.col("j") == F.col("cell"), "held": F.col("j") >= F.col("cell")})


def panel(ticks: DataFrame, stages: DataFrame, grid: Grid, depth_levels: tuple[int, ...] = DEPTH_LEVELS, on: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """All measures on one grid for all series: KEYS, offset_ms, prices, sizes, spread, mid, mid_move, depths, counts.

    A point holds the last update at or before it (ties: the greatest seq). updates, trades, volume and signed_volume count
    the interval since the point before, so they are unknown (NULL) at the first point. mid_move is against the last mid
    strictly before t0. Defined cases: one-sided books have NULL prices and mid but keep sizes and depth; before the first
    update all is NULL but the counts; a series whose updates all come after the grid has empty points; ticks with NULL time or
    key, and windows without a stage, have no rows.
    """
    levels = levels_of(ticks.columns)
    t = staged(ticks, stages, list(on)).filter("instrument is not null")
    valid = F.col("bid_px_0").isNotNull() & F.col("ask_px_0").isNotNull()
    state = {
        "bid_px": F.when(valid, F.col("bid_px_0")), "ask_px": F.when(valid, F.col("ask_px_0")), "bid_sz": F.col("bid_sz_0"), "ask_sz": F.col("ask_sz_0"),
        **{f"depth_{k}": depth(k, levels) for k in depth_levels},
    }
    traded, by = is_trade(), moment("ts_event", "seq")
    before = F.when(F.col("off") < 0, by)
    # Plain columns by one number: the aggregation is by hash, no tick is sorted.
    cells = t.groupBy(*KEYS, cell_of(F.col("off"), grid).alias("cell")).agg(
        *[F.max_by(e, by).alias(c) for c, e in state.items()], F.count("*").alias("updates"), F.count_if(traded).alias("trades"),
        F.sum(F.when(traded, F.col("size")).otherwise(0)).alias("volume"), F.sum(F.when(traded, F.col("size") * signed()).otherwise(0)).alias("signed_volume"),
        F.max(before).alias("pre_at"), F.max_by(touch_mid(), before).alias("pre"),
    )
    cells = cells.withColumn("pre_mid", F.max(F.when(F.col("pre_at").isNotNull(), F.struct("pre_at", "pre"))).over(Window.partitionBy(*KEYS))["pre"])
    p = _points(cells, KEYS, grid)
    held = {c: F.when(F.col("held"), F.col(c)) for c in state}
    mid = (held["bid_px"] + held["ask_px"]) / 2.0
    counts = {c: F.when(F.col("j") > 0, F.when(F.col("here"), F.col(c)).otherwise(0)) for c in ["updates", "trades", "volume", "signed_volume"]}
    out = p.select(
        *KEYS, F.expr(f"({grid.start}L + j * {grid.step}L) div 1000000L").alias("offset_ms"), *[e.alias(c) for c, e in held.items() if c in ("bid_px", "ask_px", "bid_sz", "ask_sz")],
        (held["ask_px"] - held["bid_px"]).alias("spread"), mid.alias("mid"), (mid - F.col("pre_mid")).alias("mid_move"),
        *[e.alias(c) for c, e in held.items() if c.startswith("depth")], *[e.alias(c) for c, e in counts.items()],
    )
    return out


def baselines(coarse: DataFrame, window_s: tuple[int, int]) -> DataFrame:
    """Median of each measure over [start, end) of the window per series; NULLs are skipped."""
    inside = coarse.filter((F.col("offset_ms") >= window_s[0] * 1000) & (F.col("offset_ms") < window_s[1] * 1000))
    return inside.groupBy("window_id", "event_type", "stage", "instrument").agg(*[F.median(m).alias(f"base_{m}") for m in BASELINE_MEASURES if m in coarse.columns])


def mid_changes(ticks: DataFrame, stages: DataFrame, window_s: tuple[int, int], on: tuple[str, ...] = ("window_id",), piece: int = PIECE) -> DataFrame:
    """Each change of the mid inside the window at its exact time: KEYS, offset_ns, mid_move (against the last mid before t0).

    The first mid of the window and a mid after a one-sided book count as changes. Series of very many ticks are cut along time.
    """
    lo, hi = window_s[0] * 10**9, window_s[1] * 10**9
    t = staged(ticks, stages, list(on)).withColumn("mid", touch_mid())
    pre = t.filter("off < 0").groupBy(*KEYS).agg(F.max_by("mid", moment("ts_event", "seq")).alias("pre_mid"))
    inside = with_previous(t.filter(F.col("off").between(lo, hi)).select(*KEYS, "off", "ts_event", "seq", "mid"), KEYS, "ts_event", ["mid"], ("seq",), piece)
    changed = inside.filter(F.col("mid").isNotNull() & ~F.col("mid").eqNullSafe(F.col("before.mid")))
    return changed.join(pre, KEYS, "left").select(*KEYS, F.col("off").alias("offset_ns"), (F.col("mid") - F.col("pre_mid")).alias("mid_move"))


def bar_panel(bars: DataFrame, stages: DataFrame, grid: Grid, on: tuple[str, ...] = ("window_id",), bar_ns: int = 10**9) -> DataFrame:
    """Closes and volumes of bars (window_id, instrument, ts_event = opening, close, volume) on a grid; a bar counts once it is over."""
    t = staged(bars.withColumn("ts_event", F.col("ts_event") + bar_ns), stages, list(on))
    cells = t.groupBy(*KEYS, cell_of(F.col("off"), grid).alias("cell")).agg(
        F.max_by("close", "ts_event").alias("last"), F.sum("volume").alias("volume"), F.max(F.when(F.col("off") <= 0, F.col("ts_event"))).alias("pre_at"), F.max_by("close", F.when(F.col("off") <= 0, F.col("ts_event"))).alias("pre"),
    )
    cells = cells.withColumn("pre_close", F.max(F.when(F.col("pre_at").isNotNull(), F.struct("pre_at", "pre"))).over(Window.partitionBy(*KEYS))["pre"])
    p = _points(cells, KEYS, grid)
    close = F.when(F.col("held"), F.col("last"))
    volume = F.when(F.col("j") > 0, F.when(F.col("here"), F.col("volume")).otherwise(0))
    return p.select(*KEYS, F.expr(f"({grid.start}L + j * {grid.step}L) div 1000000L").alias("offset_ms"), close.alias("close"), (close - F.col("pre_close")).alias("close_move"), volume.alias("volume"))


def spike_ratios(on_grid: DataFrame, quiet_s: tuple[int, int], spike_s: tuple[int, int]) -> DataFrame:
    """Per series the mean size of mid changes from point to point in the spike window over that in the quiet one.

    Windows are (start, end]. Without movement in the quiet window: infinite if there is any in the other, else NULL.
    """
    w = Window.partitionBy(*KEYS).orderBy("offset_ms")
    moves = on_grid.withColumn("move", F.abs(F.col("mid") - F.lag("mid").over(w)))

    def mean(span: tuple[int, int]) -> Column:
        return F.avg(F.when((F.col("offset_ms") > span[0] * 1000) & (F.col("offset_ms") <= span[1] * 1000), F.col("move")))

    both = moves.groupBy(*KEYS).agg(mean(quiet_s).alias("quiet"), mean(spike_s).alias("spike"))
    ratio = F.when(F.col("quiet") == 0, F.when(F.col("spike") > 0, F.lit(float("inf")))).otherwise(F.try_divide("spike", "quiet"))
    return both.select(*KEYS, ratio.alias("ratio"))


def confirmed_events(ratios: DataFrame, references: tuple[str, ...], least: float) -> DataFrame:
    """Per event the greatest ratio among the reference instruments, over all its stages, and whether it reaches `least`."""
    ref = ratios.filter(F.col("instrument").isin(*references))
    best = ref.groupBy(F.col("window_id").alias("event_id")).agg(F.max("ratio").alias("best_ratio"), F.max_by("instrument", F.struct("ratio", "instrument")).alias("best_instrument"))
    return best.withColumn("confirmed", F.coalesce(F.col("best_ratio") >= least, F.lit(False)))
