"""python -m tidegrid: synthetic books, calendars, plans, panels, analyses, report, replay, demonstration, and single queries."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid import config, report
from tidegrid.analyses import ANALYSES, analyse
from tidegrid.config import GridSettings, Study
from tidegrid.functions.shared import shared_folder
from tidegrid.operators import calendar, costplan
from tidegrid.plans import problems, records, study, verbs
from tidegrid.schema import MEETINGS, SURPRISE_TEXT
from tidegrid.sources import provider
from tidegrid.sources.files import exists, read_text, write_text
from tidegrid.sources.records import run_info, template, text_table, write_csv, write_with_manifest
from tidegrid.store import build_panels, read_part
from tidegrid.streaming import replay

#: What a study of synthetic books looks at: their windows are shorter than those of recorded ones.
SHORT_WINDOWS = Study(coarse=GridSettings(1000, -300, 600), baseline_s=(-300, -100), curve_s=(-100, 300), horizons_s=(1, 10, 60, 300), exits_s=(60, 300), surprise_window_s=(-200, 300), continuation_s=(60, 300, 600), quiet_s=(-280, -60), least_training=3)


class Refused(Exception):
    """A request that can't be met as asked; the exit code is 2."""


def queries() -> dict:
    return {n: f for m in (study, verbs, records, problems) for n, f in m.queries().items()}


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _settings(a: argparse.Namespace, base: Study = Study()) -> Study:
    return config.load(a.config, a.set, base)


def _books(spark: SparkSession, a: argparse.Namespace) -> tuple[provider.Books, Study]:
    if not exists(spark, f"{a.data}/books.parquet"):
        raise Refused(f"no books in {a.data}; make synthetic ones with `synth`, or put books.parquet and stages.parquet there")
    books = provider.provider_for(spark, a.data)
    return books, _settings(a, SHORT_WINDOWS if books.made_up else Study())


def _entries(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    path = f"{a.data}/surprises.csv"
    if not exists(spark, path):
        return None
    t = text_table(spark, path, _columns(SURPRISE_TEXT))
    numbers = {c: F.regexp_replace(F.trim(c), ",", "").try_cast("double") for c in ("actual", "consensus", "prior")}
    return t.withColumns({**numbers, "release_date": F.trim("release_date").try_cast("date")})


def synth(spark, a) -> int:
    provider.write_synthetic(spark, a.data, a.events, a.controls, fomc=a.fomc, seed=a.seed)
    print(f"wrote synthetic books to {a.data}")
    return 0


def calendar_command(spark, a) -> int:
    meetings, entries = f"{a.data}/meetings.csv", f"{a.data}/surprises.csv"
    if a.action == "template":
        made = [p for p, ddl in ((meetings, MEETINGS), (entries, SURPRISE_TEXT)) if template(p, _columns(ddl))]
        print("\n".join(f"wrote {p}" for p in made) or "both files exist already")
        return 0
    if a.action == "build":
        rows = calendar.meeting_rows(text_table(spark, meetings, _columns(MEETINGS)))
        if exists(spark, f"{a.data}/releases.csv"):
            r = text_table(spark, f"{a.data}/releases.csv", ["event_type", "tier", "date", "time_et", "source"])
            rows = rows.unionByName(r.select("event_type", F.col("tier").try_cast("int").alias("tier"), F.col("date").try_cast("date").alias("date"), F.lit("release").alias("stage"), "time_et", "source"))
        write_csv(calendar.calendar(rows), f"{a.data}/calendar.csv")
        print(f"wrote {a.data}/calendar.csv")
        return 0
    faults = []
    for path, ddl, check in ((meetings, MEETINGS, lambda d: calendar.meeting_faults(d, "row", a.first, a.last)), (entries, SURPRISE_TEXT, lambda d: calendar.surprise_faults(d, "row", None, a.first, a.last))):
        if exists(spark, path):
            faults += [(path, r) for r in report.rows_of(check(text_table(spark, path, _columns(ddl)).withColumn("row", F.monotonically_increasing_id())).orderBy("row"))]
    for path, r in faults:
        print(f"{path}: row {r['row'] + 2}: {r['severity']}: {r['fault']}")
    bad = sum(r["severity"] == "error" for _, r in faults)
    print(f"{bad} errors, {len(faults) - bad} warnings")
    return int(bad > 0)


def data_command(spark, a) -> int:
    cal = spark.read.option("header", True).csv(f"{a.data}/calendar.csv").withColumns({"date": F.col("date").cast("date"), "tier": F.col("tier").cast("int"), "t0_utc_ns": F.col("t0_utc_ns").cast("long")})
    if a.action == "controls":
        first, last = a.first, a.last
        days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS date")
        wanted = spark.createDataFrame([(t, int(n)) for t, _, n in (w.partition("=") for w in a.wanted)], "time_et string, n int")
        excluded = text_table(spark, f"{a.data}/exclude.csv", ["date"]).select(F.trim("date").try_cast("date").alias("date")) if exists(spark, f"{a.data}/exclude.csv") else None
        chosen = calendar.control_days(days, cal.select("time_et", "date", "tier").distinct(), calendar.holiday_table(spark, int(first[:4]), int(last[:4])), cal.filter("tier = 1"), wanted, a.seed, excluded)
        write_csv(calendar.control_windows(chosen).orderBy("t0_utc_ns"), f"{a.data}/controls.csv")
        print(f"wrote {a.data}/controls.csv")
        return 0
    windows = costplan.event_windows(cal)
    if exists(spark, f"{a.data}/controls.csv"):
        c = spark.read.option("header", True).csv(f"{a.data}/controls.csv")
        t0 = F.col("t0_utc_ns").cast("long")
        windows = windows.unionByName(c.select(F.col("control_id").alias("window_id"), F.lit("CONTROL").alias("kind"), t0.alias("first_ns"), t0.alias("last_ns"), F.col("date").cast("date").alias("date")))
    samples = spark.read.option("header", True).schema("instrument string, feed_schema string, window_id string, seconds double, cost_usd double").csv(f"{a.data}/quotes.csv")
    plan = spark.read.option("header", True).schema("instrument string, deep boolean, core boolean").csv(f"{a.data}/instruments.csv")
    schemas = spark.read.option("header", True).schema("feed_schema string, lo_s long, hi_s long, short_lo_s long, short_hi_s long, deep boolean").csv(f"{a.data}/schemas.csv")
    rates = costplan.sampled_rates(samples, a.reference)
    if a.action == "plan-costs":
        kinds = sorted(r["event_type"] for r in report.rows_of(cal.filter("tier = 1").select("event_type").distinct()))
        table = costplan.options_table(costplan.estimate(costplan.split_controls(windows, a.fewer), costplan.plan_options(plan, schemas, kinds), rates), a.budget)
        text = report.markdown_table(table.orderBy("option"))
        write_text(spark, f"{a.data}/cost_plan.md", "# Cost plan\n\n" + text)
        print(text)
        return 0
    wanted = costplan.requests(windows, plan.select("instrument", "deep"), schemas.select("feed_schema", "lo_s", "hi_s", "deep")).filter("feed_schema <> 'definition'")
    ledger = f"{a.data}/ledger"
    bought = spark.read.parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], "instrument string, feed_schema string, window_id string, start_ns long, end_ns long, cost_usd double, spent double, action string")
    spent = bought.agg(F.sum("cost_usd")).first()[0] or 0.0
    todo = costplan.purchases(wanted, bought, rates, a.budget, spent)
    for r in report.rows_of(todo.groupBy("action").agg(F.count("*").alias("requests"), F.round(F.sum("cost_usd"), 2).alias("usd")).orderBy("action")):
        print(f"{r['action']}: {r['requests']} requests, {r['usd']} USD")
    if not a.yes:
        print("dry run: nothing was bought; --yes records the purchases in the ledger")
        return 0
    todo.filter("action = 'buy'").write.mode("append").parquet(ledger)
    return 0


def panel_command(spark, a) -> int:
    if a.synthetic:
        provider.write_synthetic(spark, a.data, a.synthetic, max(1, a.synthetic))
    books, s = _books(spark, a)
    books.report.withColumn("reasons", F.array_join("reasons", "; ")).write.mode("overwrite").json(f"{a.data}/quality")
    build_panels(spark, books.ticks, books.stages, s, f"{a.data}/panels", {"synthetic": books.made_up})
    validation = read_part(spark, f"{a.data}/panels", "validation")
    write_csv(validation, f"{a.data}/validation.csv")
    print(report.validation_note(validation))
    return 0


def analyze_command(spark, a) -> int:
    books, s = _books(spark, a)
    for name in ANALYSES if a.analysis == "all" else [a.analysis]:
        print("\n".join(analyse(spark, name, f"{a.data}/panels", books, s, f"{a.data}/results", _entries(spark, a))))
    return 0


def report_command(spark, a) -> int:
    made_up = exists(spark, f"{a.data}/{provider.SCENARIO}")
    sections = {n.capitalize(): read_text(spark, p) if exists(spark, p := f"{a.data}/results/{n}/summary.md") else "" for n in ANALYSES}
    if exists(spark, f"{a.data}/panels/manifest.json"):
        sections["Validation"] = report.validation_note(read_part(spark, f"{a.data}/panels", "validation"))
    report.write_report(a.out, sections, made_up)
    if a.into:
        report.replace_block(a.into, sections["Liquidity"], made_up)
    print(f"wrote {a.out}" + (" (synthetic: not results)" if made_up else ""))
    return 0


def replay_command(spark, a) -> int:
    if a.speed <= 0:
        raise Refused("speed must be positive")
    books, _ = _books(spark, a)
    chosen = books.stages.filter("event_type <> 'CONTROL'")
    chosen = (chosen if a.window is None else chosen.filter(F.col("window_id") == a.window)).orderBy("t0_ns", "window_id").limit(1).collect()
    if not chosen:
        raise Refused("no such release window")
    window, t0 = chosen[0]["window_id"], chosen[0]["t0_ns"]
    ticks = books.ticks.filter(F.col("window_id") == window)
    ctx = replay.context(ticks, ticks.select("instrument").distinct().withColumn("t0_ns", F.lit(t0)), ["instrument"])
    span = ticks.filter((F.col("ts_event") >= t0 + a.start * replay.NS) & (F.col("ts_event") <= t0 + a.end * replay.NS)).select("instrument", "seq", "ts_event", "action", "bid_px_0", "ask_px_0", "bid_sz_0", "ask_sz_0")
    home = shared_folder(spark, "replay")
    # All instruments of the span merged in order of exchange time; one window is one small file, the paced source's input.
    span.coalesce(1).sortWithinPartitions("ts_event", "seq").write.parquet(f"{home}/in")
    for turn in range(a.loop):
        replay.register(spark)
        if a.fast:
            stream = spark.readStream.schema(span.schema).parquet(f"{home}/in")
        else:
            stream = spark.readStream.format("paced").schema(span.schema).option("path", f"{home}/in").option("speed", str(a.speed)).load()
        sink = replay.MetricsSink(a.metrics)
        query = replay.live_states(stream, ctx).writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/state-{turn}")
        query = (query.trigger(availableNow=True) if a.fast else query.trigger(processingTime="1 second")).start()
        if a.fast:
            query.awaitTermination()
        else:
            time.sleep((a.end - a.start) / a.speed + 2)
            query.processAllAvailable()
            query.stop()
        print(f"{window}: {sink.updates} updates")
    return 0


def demo_command(spark, a) -> int:
    if a.events < 3 or a.controls < 1 or a.reps < 1:
        raise Refused("a demonstration needs 3 events, 1 control and 1 repetition")
    a.synthetic, a.analysis, a.out, a.into = 0, "all", a.report, None
    a.set = [*(a.set or []), f"reps={a.reps}"]
    provider.write_synthetic(spark, a.data, a.events, a.controls, fomc=3)
    return panel_command(spark, a) or analyze_command(spark, a) or report_command(spark, a)


def run_command(spark, a) -> int:
    df = queries()[a.query](spark, a.folder)
    if not a.out:
        df.show(50, truncate=False)
    elif a.out.endswith(".csv"):
        write_csv(df, a.out)
    else:
        write_with_manifest(df, a.out, run_info(f"run {a.query}", config.TAPE) | {"folder": a.folder})
    return 0


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegrid", description=__doc__)
    p.add_argument("--config", help="settings as JSON or YAML")
    p.add_argument("--set", action="append", metavar="NAME=VALUE", help="override a setting, such as coarse.step_ms=500")
    p.add_argument("--log-level", default="ERROR", choices=["ALL", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF"])
    p.add_argument("--data", default="data", help="the folder of books, calendars, panels and results")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: tuple, parent=sub) -> None:
        c = parent.add_parser(name)
        for names, options in arguments:
            c.add_argument(*([names] if isinstance(names, str) else names), **options)
        c.set_defaults(run=run, action=name)

    def number(name: str, default) -> tuple:
        return name, {"type": type(default), "default": default}

    span = [("--first", {"default": "2024-01-01"}), ("--last", {"default": "2026-12-31"})]
    command("list", None)
    command("run", run_command, ("query", {}), ("folder", {}), ("--out", {"help": "a Parquet table with its manifest, or a .csv folder; else the first rows are shown"}))
    command("synth", synth, number("--events", 4), number("--controls", 4), number("--fomc", 0), number("--seed", 1))
    cal = sub.add_parser("calendar").add_subparsers(dest="action", required=True)
    for name in ("template", "build", "validate"):
        command(name, calendar_command, *span, parent=cal)
    data = sub.add_parser("data").add_subparsers(dest="action", required=True)
    command("controls", data_command, *span, ("wanted", {"nargs": "+", "metavar": "HH:MM=N"}), number("--seed", 20241001), parent=data)
    money = [number("--budget", 40.0), number("--reference", "ZN"), number("--fewer", 10), ("--yes", {"action": "store_true"})]
    for name in ("plan-costs", "download"):
        command(name, data_command, *money, parent=data)
    build = sub.add_parser("panel").add_subparsers(dest="action", required=True)
    command("build", panel_command, number("--synthetic", 0), parent=build)
    command("analyze", analyze_command, ("analysis", {"choices": [*ANALYSES, "all"]}))
    command("report", report_command, number("--out", "REPORT.md"), ("--into", {"help": "a file whose block between the markers is replaced; refused for synthetic books"}))
    command("replay", replay_command, ("--window", {}), ("--fast", {"action": "store_true"}), number("--speed", 1.0), number("--start", -300), number("--end", 600), ("--metrics", {"help": "a file for the latest gauges"}), number("--loop", 1))
    command("demo", demo_command, number("--events", 4), number("--controls", 4), number("--reps", 100), number("--report", "demo_report.md"))
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(queries())))
        return 0
    if a.command == "run" and a.query not in queries():
        print(f"no query {a.query}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tidegrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel(a.log_level)
    try:
        return a.run(spark, a)
    except (Refused, FileNotFoundError, KeyError, calendar.MissingTierError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
