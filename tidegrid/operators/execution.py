"""Cost of execution: walking the displayed book second by second, and when it is back to normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import Study
from tidegrid.functions.clock import control_group, group_label
from tidegrid.operators.counter_grid import Grid, cell_of
from tidegrid.operators.panel import _points, staged
from tidegrid.operators.stats import curve_intervals
from tidegrid.schema import KEYS, levels_of

CURVE = ["group", "instrument", "qty"]


def ladder(prices: list[Column], sizes: list[Column]) -> Column:
    """The levels of a side, best first, as rungs: what lies before the level (size, paid), up to and with it (upto), and its price.

    Levels without a price or size, or of negative size, hold nothing. It is made once for a book; every size climbs the same.
    """
    rungs, before, paid = [], F.lit(0).cast("long"), F.lit(0.0)
    for p, s in zip(prices, sizes):
        held = F.when(p.isNotNull(), F.greatest(F.coalesce(s, F.lit(0)), F.lit(0))).otherwise(0).cast("long")
        price = F.coalesce(p.cast("double"), F.lit(0.0))
        rungs.append(F.struct(before.alias("before"), paid.alias("paid"), (before + held).alias("upto"), price.alias("price")))
        before, paid = before + held, paid + held * price
    return F.array(*rungs)


def climb(rungs: Column, qty: Column) -> Column:
    """The rung on which `qty` is filled; NULL if the shown depth is too small."""
    return F.get(F.filter(rungs, lambda r: r["upto"] >= qty), F.lit(0))


def filled(rung: Column, qty: Column) -> Column:
    """Average price of a fill that ends on this rung."""
    return F.try_divide(rung["paid"] + (qty - rung["before"]) * rung["price"], qty)


def walk(prices: list[Column], sizes: list[Column], qty: Column) -> tuple[Column, Column]:
    """Average price of filling `qty` from the levels, and whether the shown depth is too small (then the price is NULL)."""
    rung = climb(ladder(prices, sizes), qty)
    return filled(rung, qty), rung.isNull()


def costs(ticks: DataFrame, stages: DataFrame, grid: Grid, sizes: tuple[int, ...], on: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Per grid point and order size the cost against the mid of buying, selling and their average, in ticks, and whether depth ran out."""
    levels = levels_of(ticks.columns)
    t = staged(ticks, stages, list(on))
    book = F.struct(*[f"{side}_{what}_{i}" for side in ("bid", "ask") for what in ("px", "sz") for i in range(levels)])
    cells = t.groupBy(*KEYS, cell_of(F.col("off"), grid).alias("cell")).agg(F.max_by(book, F.struct("ts_event", "seq")).alias("r"))
    # The book of a cell is walked once per size, on ladders made once; the points up to the next cell repeat its cost, not its walk.
    sides = {side: ladder([F.col(f"r.{side}_px_{i}") for i in range(levels)], [F.col(f"r.{side}_sz_{i}") for i in range(levels)]) for side in ("ask", "bid")}
    book = cells.select(*KEYS, "cell", ((F.col("r.bid_px_0") + F.col("r.ask_px_0")) / 2.0).alias("mid"), *[e.alias(side) for side, e in sides.items()])
    book = book.select(*KEYS, "cell", "mid", *[climb(F.col(side), F.lit(q)).alias(f"{side}_{q}") for side in sides for q in sizes])
    at = {q: (filled(F.col(f"ask_{q}"), F.lit(q)) - F.col("mid"), F.col("mid") - filled(F.col(f"bid_{q}"), F.lit(q)), F.col(f"ask_{q}").isNull() | F.col(f"bid_{q}").isNull()) for q in sizes}
    walked = book.select(*KEYS, "cell", F.array(*[F.struct(F.lit(q).alias("qty"), buy.alias("buy"), sell.alias("sell"), short.alias("short")) for q, (buy, sell, short) in at.items()]).alias("w"))
    p = _points(walked, KEYS, grid)
    nothing = F.array(*[F.struct(F.lit(q).alias("qty"), F.lit(None).cast("double").alias("buy"), F.lit(None).cast("double").alias("sell"), F.lit(True).alias("short")) for q in sizes])
    p = p.select(*KEYS, F.expr(f"({grid.start}L + j * {grid.step}L) div 1000000000L").alias("offset_s"), F.explode(F.when(F.col("held"), F.col("w")).otherwise(nothing)).alias("w"))
    group = group_label(F.col("event_type"), F.col("stage"), F.col("time_et"))
    return p.select(
        "window_id", group.alias("group"), "instrument", "offset_s", F.col("w.qty").alias("qty"), F.col("w.buy").alias("buy_ticks"), F.col("w.sell").alias("sell_ticks"),
        ((F.col("w.buy") + F.col("w.sell")) / 2).alias("cost_ticks"), F.col("w.short").alias("insufficient_depth"),
    )


def with_fees(rows: DataFrame, fee_usd: float, tick_usd: Column) -> DataFrame:
    """Fee of one side in ticks and the value of a tick; NULL where the value is unknown."""
    return rows.withColumns({"fee_ticks": F.when(tick_usd > 0, F.lit(fee_usd) / tick_usd), "tick_usd": tick_usd})


def curves(rows: DataFrame) -> DataFrame:
    """Mean cost and share of short depth per group, instrument, size and offset."""
    n = rows.select(*CURVE, "window_id").distinct().groupBy(*CURVE).agg(F.count("*").alias("n_events"))
    means = rows.groupBy(*CURVE, "offset_s").agg(F.avg("cost_ticks").alias("mean_ticks"), F.avg(F.col("insufficient_depth").cast("int")).alias("share_insufficient"))
    return means.join(n, CURVE)


def curve_bands(rows: DataFrame, study: Study) -> DataFrame:
    return curve_intervals(rows, CURVE, "window_id", "offset_s", "cost_ticks", study.reps, study.seed + 3)


def back_to_normal(curve: DataFrame, study: Study) -> DataFrame:
    """Per event group, instrument and size: normal cost (median of the control curve), early extra cost, seconds to normal.

    Normal again means at most normal_multiple times the normal cost at `hold` points on end, from t0 on.
    """
    normal = curve.groupBy(*CURVE).agg(F.median("mean_ticks").alias("normal_ticks"), F.max("n_events").alias("n_control"))
    normal = normal.select(F.col("group").alias("control_group"), "instrument", "qty", "normal_ticks", "n_control")
    d = curve.withColumn("control_group", control_group(F.col("group"))).join(normal, ["control_group", "instrument", "qty"])
    ok = F.coalesce(F.col("mean_ticks") <= study.normal_multiple * F.col("normal_ticks"), F.lit(False)).cast("int")
    ahead = Window.partitionBy(*CURVE).orderBy("offset_s").rowsBetween(0, study.hold - 1)
    d = d.withColumn("held", F.sum(ok).over(ahead) >= study.hold)
    early = F.avg(F.when((F.col("offset_s") >= 0) & (F.col("offset_s") < study.early_s), F.col("mean_ticks")))
    out = d.groupBy(*CURVE, "normal_ticks", "n_control").agg(
        F.max("n_events").alias("n_events"), early.alias("first_5s_ticks"), F.min(F.when(F.col("held") & (F.col("offset_s") >= 0), F.col("offset_s"))).cast("double").alias("seconds_to_normal"),
        F.max("share_insufficient").alias("max_share_insufficient"),
    )
    return out.withColumn("extra_first_5s_ticks", F.col("first_5s_ticks") - F.col("normal_ticks"))
