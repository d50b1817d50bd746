"""What a download would cost: windows, requests, sampled quotes, options against a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import PIECE
from tidegrid.functions.previous import running

NS = 10**9
DAY = 86_400 * NS


def event_windows(calendar: DataFrame) -> DataFrame:
    """One window per event over all its stages: window_id, kind, first_ns, last_ns, date."""
    return calendar.groupBy(F.col("event_id").alias("window_id"), F.col("event_type").alias("kind")).agg(F.min("t0_utc_ns").alias("first_ns"), F.max("t0_utc_ns").alias("last_ns"), F.min("date").alias("date"))


def requests(windows: DataFrame, instruments: DataFrame, schemas: DataFrame) -> DataFrame:
    """Requests of every window, schema and instrument: instrument, feed_schema, window_id, start_ns, end_ns.

    instruments: instrument, deep; schemas: feed_schema, lo_s, hi_s, deep (only for deep instruments). Both are short
    parameter tables. Definitions are asked for once per instrument and day.
    """
    i, s = F.broadcast(instruments), F.broadcast(schemas.withColumnRenamed("deep", "needs_deep"))
    data = windows.join(i).join(s).filter(~F.col("needs_deep") | F.col("deep"))
    data = data.select("instrument", "feed_schema", "window_id", (F.col("first_ns") + F.col("lo_s") * NS).alias("start_ns"), (F.col("last_ns") + F.col("hi_s") * NS).alias("end_ns"))
    day0 = F.call_function("div", F.col("first_ns"), F.lit(DAY).cast("long")) * DAY
    defs = windows.join(i).select("instrument", F.lit("definition").alias("feed_schema"), F.date_format("date", "yyyy-MM-dd").alias("window_id"), day0.alias("start_ns"), (day0 + DAY).alias("end_ns"))
    return first_of(data.unionByName(defs), ["instrument", "feed_schema", "window_id"], "start_ns")


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the order given, the rest of the row breaking ties; without a window, so that hot keys reduce early."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def estimate(windows: DataFrame, options: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of each option: option, feed_schema, instrument, windows, cost_usd.

    options: option, feed_schema, instrument, lo_s, hi_s, kinds (array of window kinds taken); rates: feed_schema, instrument,
    usd_per_s. Window lengths are summed per kind before the short option table meets them.
    """
    by_kind = windows.groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("last_ns") - F.col("first_ns")) / NS).alias("between_s"))
    o = options.select("*", F.explode("kinds").alias("kind")).join(by_kind, "kind").join(rates, ["feed_schema", "instrument"])
    part = o.groupBy("option", "feed_schema", "instrument").agg(F.sum("n").alias("windows"), F.sum((F.col("between_s") + F.col("n") * (F.col("hi_s") - F.col("lo_s"))) * F.col("usd_per_s")).alias("cost_usd"))
    return part


def sampled_rates(samples: DataFrame, reference: str) -> DataFrame:
    """feed_schema, instrument, usd_per_s from sampled quotes (instrument, feed_schema, window_id, seconds, cost_usd).

    The reference instrument's rate is its cost by second over all its samples; another instrument's is that times the ratio
    of their costs on a window that both have (1 where the reference costs nothing).
    """
    ref = samples.filter(F.col("instrument") == reference)
    own = ref.groupBy("feed_schema").agg((F.sum("cost_usd") / F.sum("seconds")).alias("usd_per_s"))
    both = samples.filter(F.col("instrument") != reference).alias("s").join(ref.alias("r"), ["feed_schema", "window_id"]).groupBy("feed_schema", F.col("s.instrument").alias("instrument")).agg(
        F.min_by(F.when(F.col("r.cost_usd") > 0, F.col("s.cost_usd") / F.col("r.cost_usd")).otherwise(1.0), "window_id").alias("ratio")
    )
    others = both.join(own, "feed_schema").select("feed_schema", "instrument", (F.col("usd_per_s") * F.col("ratio")).alias("usd_per_s"))
    return own.select("feed_schema", F.lit(reference).alias("instrument"), "usd_per_s").unionByName(others)


def split_controls(windows: DataFrame, fewer: int) -> DataFrame:
    """The windows with their controls' kind split into "CONTROL" (the first `fewer` of each clock time) and "CONTROL_REST"."""
    clock = F.pmod(F.col("first_ns"), F.lit(DAY))
    place = F.row_number().over(Window.partitionBy("kind", clock).orderBy("first_ns", "window_id"))
    return windows.withColumn("kind", F.when((F.col("kind") == "CONTROL") & (place > fewer), "CONTROL_REST").otherwise(F.col("kind")))


def plan_options(instruments: DataFrame, schemas: DataFrame, kinds: list[str]) -> DataFrame:
    """The five options: all, core instruments only, shorter windows, fewer control days, and these three trims together.

    instruments: instrument, deep, core; schemas: feed_schema, lo_s, hi_s, short_lo_s, short_hi_s, deep; kinds: the kinds of
    windows but controls. For estimate(): option, feed_schema, instrument, lo_s, hi_s, kinds. Short parameter tables.
    """
    pairs = F.broadcast(instruments.withColumnRenamed("deep", "is_deep")).join(schemas).filter("not deep or is_deep")
    every, fewer = [*kinds, "CONTROL", "CONTROL_REST"], [*kinds, "CONTROL"]
    trims = (("full plan", 0, 0, 0), ("core instruments only", 1, 0, 0), ("shorter windows", 0, 1, 0), ("fewer control days", 0, 0, 1), ("all three trims", 1, 1, 1))
    out = None
    for name, core, short, few in trims:
        d = pairs.filter("core") if core else pairs
        lo, hi = (F.coalesce("short_lo_s", "lo_s"), F.coalesce("short_hi_s", "hi_s")) if short else (F.col("lo_s"), F.col("hi_s"))
        d = d.select(F.lit(name).alias("option"), "feed_schema", "instrument", lo.alias("lo_s"), hi.alias("hi_s"), F.array(*map(F.lit, fewer if few else every)).alias("kinds"))
        out = d if out is None else out.unionByName(d)
    return out


def purchases(wanted: DataFrame, cached: DataFrame, rates: DataFrame, budget: float, spent: float = 0.0) -> DataFrame:
    """What to do with each request, in order: "cached" (no call), "buy" while the running sum is within the budget, else "over budget".

    wanted: instrument, feed_schema, window_id, start_ns, end_ns; cached: instrument, feed_schema, window_id; spent: what the
    ledger already holds. A dry run is this table; a purchase appends its "buy" rows to the ledger.
    """
    keys = ["instrument", "feed_schema", "window_id"]
    d = wanted.join(cached.select(*keys).distinct().withColumn("__have", F.lit(True)), keys, "left").join(F.broadcast(rates), ["feed_schema", "instrument"], "left")
    cost = F.when(F.col("__have"), 0.0).otherwise(F.coalesce("usd_per_s", F.lit(0.0)) * (F.col("end_ns") - F.col("start_ns")) / NS)
    d = within_budget(d.withColumn("cost_usd", cost), [], ["start_ns", *keys], "cost_usd", budget - spent)
    action = F.when(F.col("__have"), "cached").when(F.col("allowed"), "buy").otherwise("over budget")
    return d.select(*keys, "start_ns", "end_ns", "cost_usd", (F.col("spent") + spent).alias("spent"), action.alias("action"))


def options_table(detail: DataFrame, budget: float) -> DataFrame:
    return detail.groupBy("option").agg(F.round(F.sum("cost_usd"), 2).alias("cost_usd")).withColumn("fits_budget", F.col("cost_usd") <= budget)


def within_budget(df: DataFrame, group: list[str], order: list[str], cost: str, budget: float, piece: int = PIECE) -> DataFrame:
    """Purchases in order with the running sum spent, and whether it is still within the budget."""
    return running(df, group, order, {"spent": F.col(cost)}, piece=piece).withColumn("allowed", F.col("spent") <= budget)
