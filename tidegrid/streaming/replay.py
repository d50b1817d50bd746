"""Replay of recorded books as a stream: latest state and trailing counts per instrument, alerts, rates."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.panel import is_trade, touch_mid

NS = 10**9
STATE = "updates bigint, spread bigint, depth bigint, mid_move double, last_ns bigint, trades array<bigint>"
OUTPUT = "instrument string, seq bigint, ts_event bigint, spread bigint, depth bigint, depth_pct double, mid_move double, trades_1s bigint, updates bigint"


def context(ticks: DataFrame, t0: DataFrame, keys: list[str], first_span_s: tuple[int, int] = (-1800, -600), second_span_s: tuple[int, int] = (-1800, -60), least: int = 50) -> DataFrame:
    """What a replay needs beforehand, per key: base_depth (median depth of the first span with enough rows, else NULL) and pre_mid."""
    d = ticks.join(t0, keys).withColumn("off", F.col("ts_event") - F.col("t0_ns")).withColumn("depth", F.col("bid_sz_0") + F.col("ask_sz_0"))

    def inside(span: tuple[int, int]):
        return (F.col("off") >= span[0] * NS) & (F.col("off") < span[1] * NS)

    a = d.groupBy(*keys).agg(
        F.count_if(inside(first_span_s)).alias("n1"), F.median(F.when(inside(first_span_s), F.col("depth"))).alias("m1"), F.count_if(inside(second_span_s)).alias("n2"),
        F.median(F.when(inside(second_span_s), F.col("depth"))).alias("m2"), F.max(F.when(F.col("off") < 0, F.struct("ts_event", "seq", touch_mid().alias("mid"))))["mid"].alias("pre_mid"),
    )
    return a.select(*keys, F.when(F.col("n1") >= least, F.col("m1")).when(F.col("n2") >= least, F.col("m2")).alias("base_depth"), "pre_mid")


def states(ticks: DataFrame, ctx: DataFrame, keys: list[str]) -> DataFrame:
    """Batch form of the replay: the state of a key after each update.

    spread and mid_move keep their last value through one-sided books; trades_1s counts the trades in the second up to the
    update; among updates of one moment the order is seq.
    """
    d = ticks.join(ctx, keys, "left")
    w = Window.partitionBy(*keys).orderBy("ts_event", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("bid_px_0").isNotNull() & F.col("ask_px_0").isNotNull()
    depth = F.col("bid_sz_0") + F.col("ask_sz_0")
    before = F.sum(is_trade().cast("int")).over(Window.partitionBy(*keys).orderBy("ts_event").rangeBetween(-(NS - 1), -1))
    same = F.sum(is_trade().cast("int")).over(Window.partitionBy(*keys, "ts_event").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return d.select(
        *keys, "seq", "ts_event", F.last(F.when(both, F.col("ask_px_0") - F.col("bid_px_0")), ignorenulls=True).over(upto).alias("spread"), depth.alias("depth"),
        F.try_divide(100.0 * depth, F.col("base_depth")).alias("depth_pct"), F.last(F.when(both, touch_mid() - F.col("pre_mid")), ignorenulls=True).over(upto).alias("mid_move"),
        (F.coalesce(before, F.lit(0)) + same).alias("trades_1s"), F.count("*").over(upto).alias("updates"),
    )


def alerts(state_rows: DataFrame, keys: list[str], spread: int = 3, depth_pct: float = 25.0, silence_s: int = 5) -> DataFrame:
    """Alerts of a replay: keys, seq, alert, one row per update and rule that fires ("wide spread", "thin depth", "no data")."""
    gap = F.col("ts_event") - F.lag("ts_event").over(Window.partitionBy(*keys).orderBy("ts_event", "seq"))
    rules = F.array_compact(F.array(
        F.when(F.col("spread") > spread, "wide spread"), F.when(F.col("depth_pct") < depth_pct, "thin depth"), F.when(gap > silence_s * NS, "no data"),
    ))
    return state_rows.withColumn("rules", rules).select(*keys, "seq", F.explode("rules").alias("alert"))


def live_states(stream: DataFrame, ctx: DataFrame) -> DataFrame:
    """Streaming form, keyed by instrument: the same rows as states(), from state kept between micro-batches.

    ctx (instrument, base_depth, pre_mid) is joined to the stream. Within a micro-batch updates are put in order; updates that
    arrive in a later batch than younger ones count from then on.
    """
    joined = stream.join(ctx, "instrument", "left").select("instrument", "seq", "ts_event", "action", "bid_px_0", "ask_px_0", "bid_sz_0", "ask_sz_0", "base_depth", "pre_mid")
    return joined.groupBy("instrument").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    updates, spread, depth, move, last, trades = state.get if state.exists else (0, None, None, None, None, [])
    p = pd.concat(list(parts)).sort_values(["ts_event", "seq"], ignore_index=True)
    at, bid, ask = p["ts_event"].to_numpy(np.int64), p["bid_px_0"].astype("float64"), p["ask_px_0"].astype("float64")
    spreads = (ask - bid).ffill().fillna(np.nan if spread is None else spread)
    moves = ((bid + ask) / 2 - p["pre_mid"].astype("float64")).ffill().fillna(np.nan if move is None else move)
    depths = (p["bid_sz_0"] + p["ask_sz_0"]).astype("int64")
    traded = p["action"].isin((3, 4)).to_numpy()
    # Trades up to each update, less those that are a second old by then.
    every = np.sort(np.concatenate((np.array(list(trades), np.int64), at[traded])))
    recent = len(trades) + np.cumsum(traded) - np.searchsorted(every, at - NS, side="right")
    base = p["base_depth"].astype("float64")
    out = pd.DataFrame({
        "instrument": key[0], "seq": p["seq"].astype("int64"), "ts_event": at, "spread": spreads.astype("Int64"), "depth": depths, "depth_pct": (100.0 * depths / base.where(base != 0)), "mid_move": moves,
        "trades_1s": recent.astype("int64"), "updates": updates + np.arange(1, len(p) + 1),
    }).replace({np.nan: None})
    out["spread"] = out["spread"].astype("Int64")
    end = int(at.max()) if last is None else max(int(at.max()), last)
    known = (lambda x: None if pd.isna(x) else x)
    s = known(spreads.iloc[-1])
    state.update((updates + len(p), None if s is None else int(s), int(depths.iloc[-1]), known(moves.iloc[-1]), end, [int(t) for t in every[every > end - NS]]))
    yield out


def silences(latest: DataFrame, now_ns: int, silence_s: int = 5) -> DataFrame:
    """Instruments without an update for longer than silence_s by the clock of the replay, whether or not data comes again: instrument, alert."""
    return latest.filter(F.lit(now_ns) - F.col("ts_event") > silence_s * NS).select("instrument", F.lit("no data").alias("alert"))


def update_rates(ticks: DataFrame, keys: list[str], span: str, late: str | None = None) -> DataFrame:
    """Updates and trades per tumbling window of event time; with `late` a watermark, so that windows of a stream close."""
    d = ticks.withColumn("at", F.timestamp_micros(F.expr("ts_event div 1000")))
    d = d.withWatermark("at", late) if late else d
    n = d.groupBy(*keys, F.window("at", span).alias("w")).agg(F.count("*").alias("updates"), F.count_if(is_trade()).alias("trades"))
    return n.select(*keys, F.col("w.start").alias("window_start"), "updates", "trades")


class PacedReader(SimpleDataSourceStreamReader):
    """Rows of a Parquet file in order of ts_event, released as wall-clock time times `speed` reaches them."""

    def __init__(self, schema, options: dict[str, str]):
        import pyarrow.parquet as pq

        self.names = [f.name for f in schema.fields]
        self.speed = float(options.get("speed", "1"))
        if self.speed <= 0:
            raise ValueError("speed must be positive")
        path = options["path"].removeprefix("file:")
        self.rows = pq.read_table(path, columns=self.names).sort_by([("ts_event", "ascending")])
        self.times = self.rows.column("ts_event").to_numpy()
        self.began = time.time()

    def initialOffset(self) -> dict:
        return {"row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import numpy as np

        due = self.times[0] + (time.time() - self.began) * self.speed * NS if len(self.times) else 0
        end = max(start["row"], int(np.searchsorted(self.times, due, side="right")))
        return self._slice(start["row"], end), {"row": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._slice(start["row"], end["row"])

    def _slice(self, a: int, b: int) -> Iterator[tuple]:
        return iter(list(zip(*[c.to_pylist() for c in self.rows.slice(a, b - a).columns])) if b > a else [])

    def commit(self, end: dict) -> None:
        pass


class PacedSource(DataSource):
    """format("paced"): options path and speed; for demonstrations on small files."""

    @classmethod
    def name(cls) -> str:
        return "paced"

    def simpleStreamReader(self, schema: Any) -> PacedReader:
        return PacedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacedSource)


class MetricsSink:
    """A foreachBatch sink: the latest state of each instrument, the count of updates and the clock, as text in a file for scraping.

    Alerts of the latest states go there too, silence by the time of the batch included.
    """

    def __init__(self, path: str | None, silence_s: int = 5):
        self.path, self.silence_s, self.updates = path, silence_s, 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("instrument").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "instrument"]), F.struct("ts_event", "seq")).alias("r"), F.count("*").alias("n")).select("instrument", "r.*", "n")
        rows = latest.limit(10_000).collect()  # one row an instrument
        if not rows:
            return
        self.updates += sum(r["n"] for r in rows)
        now = max(r["ts_event"] for r in rows)
        quiet = {r["instrument"] for r in rows if now - r["ts_event"] > self.silence_s * NS}
        if self.path:
            from tidegrid.sources.files import write_text

            alerts = "".join(f'replay_no_data{{instrument="{i}"}} 1\n' for i in sorted(quiet))
            write_text(batch.sparkSession, self.path, exposition(rows) + f"replay_updates_total {self.updates}\nreplay_clock_ns {now}\n" + alerts)


def exposition(rows: list, prefix: str = "replay") -> str:
    """Text exposition of the latest state of each instrument, for scraping."""
    out = []
    for r in rows:
        for name in ("spread", "depth", "depth_pct", "mid_move", "trades_1s", "updates"):
            if r[name] is not None:
                out.append(f'{prefix}_{name}{{instrument="{r["instrument"]}"}} {r[name]}')
    return "\n".join(out) + "\n"
