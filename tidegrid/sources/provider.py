"""Where books come from: one table of ticks for all windows and instruments, with stages and definitions beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import quality
from tidegrid.sources import synthetic
from tidegrid.sources.files import exists, read_json, write_json

NS = 10**9
SCENARIO = "scenario.json"


@dataclass
class Books:
    """ticks and stages of a study; definitions (instrument, tick_size, multiplier) may be missing; report: the quality of each window."""

    ticks: DataFrame
    stages: DataFrame
    definitions: DataFrame | None = None
    report: DataFrame | None = None
    made_up: bool = False


def gate(books: Books, before_s: int, after_s: int, core_s: tuple[int, int] = (-60, 120), **limits) -> Books:
    """Only windows that the quality check does not reject, and the report of all: window_id, instrument, counts, status, reasons."""
    t0 = books.stages.groupBy("window_id").agg(F.min("t0_ns").alias("t0_ns"), F.max("t0_ns").alias("last"))
    windows = t0.select("window_id", "t0_ns", (F.col("t0_ns") - before_s * NS).alias("start_ns"), (F.col("last") + after_s * NS).alias("end_ns"))
    report = quality.verdict(quality.check_windows(books.ticks, windows, ["window_id", "instrument"], core_s), **limits)
    rejected = report.filter("status = 'reject'").select("window_id", "instrument")
    return Books(books.ticks.join(rejected, ["window_id", "instrument"], "left_anti"), books.stages, books.definitions, report, books.made_up)


def check_tick_sizes(definitions: DataFrame, expected: dict[str, float]) -> None:
    """An error naming the instruments whose tick size in the vendor's definitions differs from the one configured."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("instrument")]
    wrong = definitions.filter(F.abs(F.col("tick_size") - want) > 1e-12).select("instrument").distinct().orderBy("instrument").limit(20).collect()
    if wrong:
        raise ValueError("tick size differs from the definitions: " + ", ".join(r["instrument"] for r in wrong))


#: Instruments of synthetic studies: updates a second, first price (ticks), depth, share of trades, steps a second, ticks a unit of surprise, lag.
INSTRUMENTS = "instrument string, rate double, start_price long, base_depth double, trade_share double, vol double, jump double, lag_ms int"
MADE_UP = [("ZN", 6.0, 7168, 900.0, 0.15, 0.05, -4.0, 0), ("ZT", 4.0, 6600, 1200.0, 0.15, 0.03, -2.0, 2), ("ES", 8.0, 20_000, 300.0, 0.2, 0.1, -6.0, 5)]


def write_synthetic(spark: SparkSession, folder: str, per_type: int, controls: int, before_s: int = 300, after_s: int = 600, fomc: int = 0, seed: int = 1) -> None:
    """A synthetic study in a folder: ticks, stages and the scenario that makes provider_for treat it as made up."""
    stages = synthetic.study_calendar(spark, per_type, controls, seed=seed, fomc=fomc)
    ticks = synthetic.books(spark, stages, spark.createDataFrame(MADE_UP, INSTRUMENTS), -before_s, after_s, seed)
    stages.write.mode("overwrite").parquet(f"{folder}/stages.parquet")
    ticks.write.mode("overwrite").parquet(f"{folder}/books.parquet")
    write_json(spark, f"{folder}/{SCENARIO}", {"per_type": per_type, "controls": controls, "fomc": fomc, "seed": seed, "before_s": before_s, "after_s": after_s})


def provider_for(spark: SparkSession, folder: str, expected_ticks: dict[str, float] | None = None, **limits) -> Books:
    """The books of a folder (books.parquet, stages.parquet, perhaps definitions.parquet), rejected windows left out.

    A folder with a scenario holds synthetic books, which are not judged.
    """
    made_up = exists(spark, f"{folder}/{SCENARIO}")
    definitions = spark.read.parquet(f"{folder}/definitions.parquet") if exists(spark, f"{folder}/definitions.parquet") else None
    books = Books(spark.read.parquet(f"{folder}/books.parquet"), spark.read.parquet(f"{folder}/stages.parquet"), definitions, None, made_up)
    if definitions is not None and expected_ticks:
        check_tick_sizes(definitions, expected_ticks)
    if made_up:
        scenario = read_json(spark, f"{folder}/{SCENARIO}")
        return gate(books, scenario["before_s"], scenario["after_s"], **({"crossed_tolerance": 1 << 60, "most_gap_s": 1e9} | limits))
    return gate(books, **({"before_s": 1800, "after_s": 3600} | limits))
