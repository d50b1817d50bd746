"""The five analyses on stored panels: tables and sentences of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import report
from tidegrid.config import Study
from tidegrid.operators import execution, liquidity, reaction, regression, stats, strategy
from tidegrid.sources.files import write_json, write_text
from tidegrid.sources.provider import Books
from tidegrid.sources.records import run_info, write_with_manifest
from tidegrid.store import read_part


def _liquidity(spark: SparkSession, store: str, books: Books, study: Study) -> dict[str, DataFrame]:
    panel = liquidity.with_baselines(read_part(spark, store, "coarse"), read_part(spark, store, "baselines"))
    events = liquidity.event_metrics(panel, study).join(liquidity.withdrawal_starts(panel, study), liquidity.SERIES)
    points = liquidity.curve_points(panel, study.curve_s)
    curves = stats.curve_intervals(points, ["group", "instrument", "measure"], "window_id", "offset_s", "value", study.reps, study.seed)
    return {"curves": curves, "events": events, "summary": liquidity.against_controls(liquidity.summary(events, liquidity.METRICS, study))}


def _reaction(spark: SparkSession, store: str, books: Books, study: Study) -> dict[str, DataFrame]:
    fine, coarse = read_part(spark, store, "fine"), read_part(spark, store, "coarse")
    k = reaction.thresholds(fine, study.first_move_quantile)
    first = reaction.first_moves(read_part(spark, store, "moves"), k)
    jumps = reaction.jump_sizes(coarse, study)
    return {"thresholds": k, "first_moves": first, "ranking": reaction.ranking(first, study), "jumps": jumps, "jump_summary": reaction.jump_summary(jumps), "lead_lag": reaction.lead_lag(fine, study)}


def surprises_of(books: Books, entries: DataFrame | None = None) -> DataFrame:
    """event_id, event_type, release_date, surprise, z: of the entries' primary variables, or those planted in synthetic books."""
    if entries is not None:
        return regression.raw_surprises(entries)
    if "z" not in books.stages.columns:
        raise ValueError("no surprises: neither entries nor synthetic books")
    one = books.stages.filter("effect").groupBy("window_id", "event_type").agg(F.min("t0_ns").alias("t0_ns"), F.first("z").alias("z"))
    day = F.timestamp_micros(F.expr("t0_ns div 1000")).cast("date")
    return one.select(F.col("window_id").alias("event_id"), "event_type", day.alias("release_date"), F.col("z").alias("surprise"), "z")


def _regression(spark: SparkSession, store: str, books: Books, study: Study, entries: DataFrame | None = None) -> dict[str, DataFrame]:
    coarse = read_part(spark, store, "coarse")
    returns = regression.returns_at_horizons(coarse, study)
    z = surprises_of(books, entries).filter("event_type <> 'FOMC'").select("event_id", "event_type", "z").unionByName(regression.implied_surprises(coarse, study).select("event_id", "event_type", "z"))
    return {"returns": returns, "regressions": regression.regressions(returns, z, study), "continuation": regression.continuation(coarse, study)}


def _with_ticks(rows: DataFrame, books: Books, study: Study) -> DataFrame:
    """tick_usd by instrument: tick size times multiplier of its definition, or the study's value for all."""
    if books.definitions is None:
        return rows.withColumn("tick_usd", F.lit(study.tick_usd))
    return rows.join(books.definitions.select("instrument", (F.col("tick_size") * F.col("multiplier")).alias("tick_usd")), "instrument", "left")


def _execution(spark: SparkSession, store: str, books: Books, study: Study) -> dict[str, DataFrame]:
    grid = study.coarse.grid("coarse")
    rows = execution.costs(books.ticks, books.stages, grid, study.order_sizes)
    return {"costs": execution.with_fees(_with_ticks(rows, books, study), study.fee_usd, F.col("tick_usd")), "curves": execution.curve_bands(rows, study), "normal": execution.back_to_normal(execution.curves(rows), study)}


def _strategy(spark: SparkSession, store: str, books: Books, study: Study, entries: DataFrame | None = None) -> dict[str, DataFrame]:
    definitions = None if books.definitions is None else books.definitions.select("instrument", (F.col("tick_size") * F.col("multiplier")).alias("tick_usd"))
    trades = strategy.backtest(read_part(spark, store, "coarse"), surprises_of(books, entries), study, definitions)
    return {"trades": trades, "summary": strategy.summary_with_intervals(trades, study)}


ANALYSES = {"liquidity": _liquidity, "reaction": _reaction, "regression": _regression, "execution": _execution, "strategy": _strategy}
SENTENCES = {
    "liquidity": ("summary", lambda d, s: report.liquidity_sentences(d, s.reference)), "reaction": ("ranking", lambda d, s: report.reaction_sentences(d)),
    "regression": ("regressions", lambda d, s: report.regression_sentences(d)), "execution": ("normal", lambda d, s: report.execution_sentences(d)), "strategy": ("summary", lambda d, s: report.strategy_sentences(d)),
}
#: Tables short enough for the report.
SHORT = {"liquidity": "summary", "reaction": "ranking", "regression": "continuation", "execution": "normal", "strategy": "summary"}


def analyse(spark: SparkSession, name: str, store: str, books: Books, study: Study, out: str, entries: DataFrame | None = None) -> list[str]:
    """Write the tables of an analysis below `out`, its sentences and its manifest; the sentences."""
    more = {"entries": entries} if name in ("regression", "strategy") else {}
    tables = ANALYSES[name](spark, store, books, study, **more)
    for part, df in tables.items():
        write_with_manifest(df, f"{out}/{name}/{part}", {"analysis": name})
    from_table, make = SENTENCES[name]
    written = spark.read.parquet(f"{out}/{name}/{from_table}")
    lines = [r["sentence"] for r in report.rows_of(make(written, study))]
    short = report.markdown_table(spark.read.parquet(f"{out}/{name}/{SHORT[name]}"))
    write_text(spark, f"{out}/{name}/summary.md", "\n".join(f"- {x}" for x in lines) + "\n\n" + short)
    write_json(spark, f"{out}/{name}/manifest.json", run_info(f"analyze {name}", study) | {"synthetic": books.made_up})
    return lines
