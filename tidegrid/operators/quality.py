"""Quality of a window's records: counts of faults, gaps and edges, roll period, verdict with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import CHUNK, PIECE, assign_chunks
from tidegrid.functions.previous import with_previous
from tidegrid.operators.panel import is_trade

NS = 10**9
#: Days before the front contract's expiration that count as its roll period.
ROLL_DAYS = {"ZT": 35, "ZF": 35, "ZN": 35, "ZB": 35, "ES": 12, "GC": 35, "CL": 10, "6E": 12, "6J": 12, "SR3": 12}


def check_windows(ticks: DataFrame, windows: DataFrame, keys: list[str], core_s: tuple[int, int] = (-60, 120), piece: int = PIECE) -> DataFrame:
    """Counts per window and instrument of `ticks` (keys, seq in order of arrival, ts_event, action, size, prices and sizes by level).

    windows: keys or the first of them (then all instruments that the ticks have there), start_ns, end_ns, t0_ns. Counted are
    rows; times, and the vendor's own `sequence` where there is one, running backwards in order of arrival; repeated rows (the
    rows that have a twin, halved); crossed, locked and one-sided books; negative sizes at any level and trades without size.
    max_gap_s is the longest silence within the window, its edges included, max_gap_core_s within core_s around t0. Where the
    ticks carry instrument_id or raw_symbol, instrument_ids, raw_symbols and contracts (their number) are given. A window
    without rows, where the windows name all keys, has rows = 0 and NULL measures. One pass over the ticks: both orders are
    windows of the same exchange; hot windows are cut along arrival and along time, the row before a cut being carried over.
    """
    on, own = [k for k in keys if k in windows.columns], ticks.columns
    has = [c for c in ("sequence", "instrument_id", "raw_symbol") if c in own]
    t = ticks.withColumn("__row", F.xxhash64(*own)).join(windows.select(*on, "start_ns", "end_ns", "t0_ns"), on)
    arrival = ["seq", "ts_event", "__row"]
    c = assign_chunks(t, keys, arrival, piece)
    last = F.struct(*arrival, *[h for h in has if h == "sequence"])
    kind = c.df.select(last.alias("s")).schema["s"].dataType.simpleString()
    rows = c.join_carry(c.carry({"end": F.max(last)}, {"__c": (F.max("end"), True)}), ["__c"], {"__c": kind})
    w = c.window(*arrival)
    before, after = F.coalesce(F.lag(last).over(w), F.col("__c")), F.lead(F.struct(*arrival)).over(w)  # a twin is in the same piece
    here = F.struct(*arrival)
    rows = rows.withColumns({"__b": before, "__n": after}).withColumns({
        "__back": F.col("ts_event") < F.col("__b.ts_event"), "__back_seq": F.col("sequence") < F.col("__b.sequence") if "sequence" in has else F.lit(False),
        "__twin": F.coalesce(here == F.struct(*[F.col(f"__b.{a}") for a in arrival]), F.lit(False)) | F.coalesce(here == F.col("__n"), F.lit(False)),
    }).drop("__c", "__b", "__n", "__is_cut", CHUNK)
    rows = with_previous(rows, keys, "ts_event", [], (), piece, ticks)

    def silence(lo: Column, hi: Column) -> Column:
        """The longest time without an update between lo and hi."""
        inside = F.col("ts_event").between(lo, hi)
        within = F.max(F.when(inside, F.col("ts_event") - F.greatest(F.coalesce(F.col("before.__o"), lo), lo)))
        return F.greatest(within, F.first(hi) - F.coalesce(F.max(F.when(inside, F.col("ts_event"))), F.first(lo))) / NS

    both = F.col("bid_px_0").isNotNull() & F.col("ask_px_0").isNotNull()
    sizes = [c for c in own if "_sz_" in c]
    bad = (F.least(*sizes) < 0) | (is_trade() & (F.col("size") <= 0))
    names = {"instrument_id": "instrument_ids", "raw_symbol": "raw_symbols"}
    lists = [F.sort_array(F.collect_set(h)).alias(names[h]) for h in has if h in names]
    core = [F.col("t0_ns") + s * NS for s in core_s]
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if("__back").alias("out_of_order_timestamps"), *([F.count_if("__back_seq").alias("out_of_order_sequence")] if "sequence" in has else []),
        F.expr("count_if(__twin) div 2").alias("duplicate_records"), F.count_if(both & (F.col("bid_px_0") > F.col("ask_px_0"))).alias("crossed_book_rows"),
        F.count_if(both & (F.col("bid_px_0") == F.col("ask_px_0"))).alias("locked_book_rows"), F.count_if(~both).alias("one_sided_rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_size_rows"),
        F.greatest(F.lit(0.0), (F.min("ts_event") - F.first("start_ns")) / NS).alias("starts_late_s"), F.greatest(F.lit(0.0), (F.first("end_ns") - F.max("ts_event")) / NS).alias("ends_early_s"),
        silence(F.col("start_ns"), F.col("end_ns")).alias("max_gap_s"), silence(*core).alias("max_gap_core_s"), *lists,
    )
    if "instrument_id" in has:
        counts = counts.withColumn("contracts", F.size("instrument_ids"))
    if len(on) < len(keys):
        return counts
    return windows.select(*keys).join(counts, keys, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def roll_week(days_to_expiry: Column, instrument: Column, days: dict[str, int] = ROLL_DAYS) -> Column:
    """The release falls at most so many days before the expiration, and not after it."""
    limit = F.create_map(*[F.lit(x) for k, v in days.items() for x in (k, v)])[instrument]
    return F.coalesce(days_to_expiry.between(F.lit(0), limit), F.lit(False))


def verdict(q: DataFrame, crossed_tolerance: int = 0, most_gap_s: float = 5.0) -> DataFrame:
    """`q` with status and reasons: reject before warn before ok. contracts and roll_week are judged where they are given."""
    empty = F.col("rows") == 0
    reject = F.array_compact(F.array(
        F.when(empty, "no data in the window"), F.when(F.col("crossed_book_rows") > crossed_tolerance, F.format_string("%d crossed-book rows", "crossed_book_rows")),
        F.when(F.col("max_gap_core_s") > most_gap_s, F.format_string("%.1f s without data around the release", "max_gap_core_s")),
    ))
    warn = [
        F.when((F.col("out_of_order_timestamps") > 0) | ((F.col("out_of_order_sequence") > 0) if "out_of_order_sequence" in q.columns else F.lit(False)), "records out of order"),
        F.when(F.col("duplicate_records") > 0, F.format_string("%d duplicate records", "duplicate_records")), F.when(F.col("bad_size_rows") > 0, F.format_string("%d rows with impossible sizes", "bad_size_rows")),
    ]
    if "contracts" in q.columns:
        warn.append(F.when(F.col("contracts") > 1, "the front contract changed inside the window"))
    if "roll_week" in q.columns:
        warn.append(F.when(F.col("roll_week"), "release falls in the roll period"))
    warn.append(F.when(F.col("max_gap_s") > most_gap_s, F.format_string("%.1f s gap away from the release", "max_gap_s")))
    warns = F.array_compact(F.array(*warn))
    return q.withColumns({
        "status": F.when(F.size(reject) > 0, "reject").when(F.size(warns) > 0, "warn").otherwise("ok"), "reasons": F.when(F.size(reject) > 0, reject).otherwise(warns),
    })


def trailing_trades(ticks: DataFrame, keys: list[str], span_ns: int = NS) -> DataFrame:
    """Each update with the trades of its key in (ts - span, ts], itself and others of its moment included."""
    w = Window.partitionBy(*keys).orderBy("ts_event").rangeBetween(-(span_ns - 1), 0)
    return ticks.withColumn("trades_1s", F.sum(is_trade().cast("int")).over(w))
