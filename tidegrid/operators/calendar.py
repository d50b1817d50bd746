"""Release calendars, holidays, control days, validation of hand-typed files, vintages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions.clock import et_to_utc_ns

HHMM = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
WEB = r"^https?://\S+"
#: Fixed values per surprise variable: event type, unit, primary, decimals, plausible range.
VARIABLES = {
    "core_cpi_mom": ("CPI", "pct", True, 1, -1.5, 2.0), "headline_cpi_mom": ("CPI", "pct", False, 1, -2.0, 2.5), "nfp_change": ("NFP", "thousands", True, 0, -1500.0, 1500.0),
    "unemployment_rate": ("NFP", "pct", False, 1, 2.0, 15.0), "ahe_mom": ("NFP", "pct", False, 1, -1.0, 2.0),
}


#: The days on which the market is closed or thin. "fixed" days of a month, those marked "observed" moved from a
#: weekend to the nearest weekday; "nth" weekday of a month (0 is Monday), the last for -1, some days later; days from Easter.
HOLIDAYS = (
    ("New Year's Day", "observed", 1, 1), ("Martin Luther King Jr. Day", "nth", 1, 0, 3, 0), ("Presidents' Day", "nth", 2, 0, 3, 0), ("Good Friday", "easter", -2),
    ("Memorial Day", "nth", 5, 0, -1, 0), ("Juneteenth", "observed", 6, 19), ("Independence Day", "observed", 7, 4), ("Labor Day", "nth", 9, 0, 1, 0),
    ("Thanksgiving", "nth", 11, 3, 4, 0), ("Day after Thanksgiving", "nth", 11, 3, 4, 1), ("Christmas Eve", "fixed", 12, 24), ("Christmas Day", "observed", 12, 25),
)


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar, by golden number and epact."""
    golden, century = year % 19 + 1, year // 100 + 1
    leaps = 3 * century // 4 - 12
    epact = (11 * golden + 20 + (8 * century + 5) // 25 - 5 - leaps) % 30
    epact += epact == 24 or (epact == 25 and golden > 11)
    moon = 44 - epact + (30 if epact > 23 else 0)  # the full moon, as a day of March
    return dt.date(year, 3, 1) + dt.timedelta(days=moon + 6 - (5 * year // 4 - leaps - 10 + moon) % 7)


def _day(year: int, kind: str, *at: int) -> dt.date:
    """The day of a rule of HOLIDAYS in a year."""
    if kind == "easter":
        return easter(year) + dt.timedelta(days=at[0])
    if kind == "nth":
        month, weekday, n, later = at
        every = [d for k in range(31) if (d := dt.date(year, month, 1) + dt.timedelta(days=k)).month == month and d.weekday() == weekday]
        return every[n - 1 if n > 0 else n] + dt.timedelta(days=later)
    day = dt.date(year, *at)
    return day + dt.timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0) if kind == "observed" else 0)


def holidays(first: int, last: int) -> list[tuple[dt.date, str]]:
    """Days of these years on which the market is closed or thin; a year has twelve."""
    return sorted((_day(y, *rule), name) for y in range(first, last + 1) for name, *rule in HOLIDAYS)


def holiday_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.createDataFrame(holidays(first, last), "date date, name string")


def calendar(rows: DataFrame) -> DataFrame:
    """Events (event_type, tier, date, stage, time_et, source) as a calendar in order, with ids and moments.

    A second row of one event and stage is an error when the result is computed.
    """
    d = rows.withColumn("event_id", F.concat_ws("_", "event_type", F.date_format("date", "yyyy-MM-dd"))).withColumn("t0_utc_ns", et_to_utc_ns(F.col("date"), F.col("time_et")))
    n = F.count("*").over(Window.partitionBy("event_id", "stage"))
    d = d.withColumn("event_id", F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate events in calendar: "), F.col("event_id")))).otherwise(F.col("event_id")))
    utc = F.date_format(F.timestamp_micros(F.call_function("div", F.col("t0_utc_ns"), F.lit(1000).cast("long"))), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return d.select("event_id", "event_type", "tier", "date", "stage", "time_et", "t0_utc_ns", utc.alias("t0_utc"), "source").orderBy("t0_utc_ns", "event_type")


def meeting_rows(meetings: DataFrame) -> DataFrame:
    """Calendar rows of valid meetings: the statement, and the press conference if there is one."""
    stages = F.array_compact(F.array(
        F.struct(F.lit("statement").alias("stage"), F.trim("statement_time_et").alias("time_et")),
        F.when(F.length(F.trim("press_conference_time_et")) > 0, F.struct(F.lit("press_conference").alias("stage"), F.trim("press_conference_time_et").alias("time_et"))),
    ))
    d = meetings.select(F.trim("date").try_cast("date").alias("date"), F.trim("source_url").alias("source"), F.explode(stages).alias("s")).filter("date is not null")
    return d.select(F.lit("FOMC").alias("event_type"), F.lit(1).alias("tier"), "date", "s.stage", "s.time_et", "source")


def expand_stages(events: DataFrame, controls: DataFrame) -> DataFrame:
    """All stages of the study in order: the events' own, one per control, and a 14:30 one thirty minutes after each 14:00 control."""
    own = events.select(F.col("event_id").alias("window_id"), "event_type", "stage", "time_et", F.col("t0_utc_ns").alias("t0_ns"))
    later = F.when(F.col("time_et") == "14:00", F.struct(F.lit("control_1430").alias("stage"), F.lit("14:30").alias("time_et"), (F.col("t0_utc_ns") + 1_800 * 10**9).alias("t0_ns")))
    each = F.array_compact(F.array(F.struct(F.lit("control").alias("stage"), F.col("time_et").alias("time_et"), F.col("t0_utc_ns").alias("t0_ns")), later))
    c = controls.select(F.col("control_id").alias("window_id"), F.lit("CONTROL").alias("event_type"), F.explode(each).alias("s")).select("window_id", "event_type", "s.*")
    return own.unionByName(c).orderBy("t0_ns", "window_id")


def apportion(weights: DataFrame, keys: list[str], item: str, weight: str, total: Column) -> DataFrame:
    """Largest remainders: `total` split over the items of each key in proportion to their weights: keys, item, share.

    Equal remainders go to the greater weight, then the smaller item. The items of a key are few (weekdays).
    """
    w = Window.partitionBy(*keys)
    d = weights.withColumns({"__all": F.sum(weight).over(w), "__total": total})
    exact = F.col("__total") * F.col(weight) / F.col("__all")
    d = d.withColumn("__floor", F.floor(exact + 1e-9)).withColumn("__rest", F.round(exact - F.col("__floor"), 9))
    d = d.withColumn("__left", F.col("__total") - F.sum("__floor").over(w))
    rank = F.row_number().over(w.orderBy(F.col("__rest").desc(), F.col(weight).desc(), item))
    return d.withColumn("share", (F.col("__floor") + F.when(rank <= F.col("__left"), 1).otherwise(0)).cast("long")).select(*keys, item, "share")


class MissingTierError(RuntimeError):
    """Control days would be drawn without knowing the releases of the second tier."""


def control_days(
    candidates: DataFrame, busy: DataFrame, closed: DataFrame, studied: DataFrame, wanted: DataFrame, seed: int, excluded: DataFrame | None = None, need_second_tier: bool = True
) -> DataFrame:
    """Control days per clock time that match the weekdays of the studied events: time_et, date.

    candidates: date; busy: time_et, date, tier of all releases; studied: time_et, date; closed and excluded: date; wanted:
    time_et, n. Weekends, closed, excluded and busy days are out. A calendar without a release of tier 2 is an error, as
    controls could fall on such releases. Days are drawn by a seeded integer hash of the date, so the draw doesn't depend on
    partitioning; a weekday that runs out is filled up from the other free days of that clock time.
    """
    if need_second_tier and ("tier" not in busy.columns or busy.filter("tier = 2").isEmpty()):
        raise MissingTierError("the calendar has no releases of tier 2")
    closed = closed.select("date") if excluded is None else closed.select("date").union(excluded.select("date"))
    free = candidates.filter(F.weekday("date") < 5).join(closed.select("date").distinct(), "date", "left_anti")
    pool = free.join(F.broadcast(wanted.select("time_et", "n"))).join(busy.select("time_et", "date").distinct(), ["time_et", "date"], "left_anti")
    draw = (F.unix_date("date").cast("long") * 7919 + seed) * 48271 % 2147483647
    pool = pool.withColumns({"weekday": F.weekday("date"), "draw": draw})
    weights = studied.filter(F.weekday("date") < 5).groupBy("time_et", F.weekday("date").alias("weekday")).agg(F.count("*").alias("weight")).join(wanted, "time_et")
    plan = apportion(weights, ["time_et"], "weekday", "weight", F.col("n"))
    order = Window.partitionBy("time_et", "weekday").orderBy("draw", "date")
    ranked = pool.join(plan, ["time_et", "weekday"], "left").withColumn("first", F.row_number().over(order) <= F.coalesce("share", F.lit(0)))
    short = F.col("n") - F.sum(F.col("first").cast("int")).over(Window.partitionBy("time_et"))
    rest = F.row_number().over(Window.partitionBy("time_et", "first").orderBy("draw", "date"))
    return ranked.withColumns({"short": short, "rest": rest}).filter(F.col("first") | (F.col("rest") <= F.col("short"))).select("time_et", "date")


def control_windows(days: DataFrame) -> DataFrame:
    ns = et_to_utc_ns(F.col("date"), F.col("time_et"))
    return days.select(F.concat(F.lit("CONTROL"), F.translate("time_et", ":", ""), F.lit("_"), F.date_format("date", "yyyy-MM-dd")).alias("control_id"), "time_et", "date", F.date_format("date", "E").alias("weekday"), ns.alias("t0_utc_ns"))


def meeting_faults(meetings: DataFrame, row: str, first: str, last: str) -> DataFrame:
    """Faults of meeting rows, all columns text: row, severity, fault."""
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("date", "statement_time_et", "press_conference_time_et", "source_url")}
    d = meetings.select(row, *[e.alias(c) for c, e in text.items()]).withColumn("day", F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date")).try_cast("date"))
    before = F.count("*").over(Window.partitionBy("day").orderBy(row).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("again", F.col("day").isNotNull() & (before > 0))
    st, pc, good = F.col("statement_time_et"), F.col("press_conference_time_et"), F.col("day").isNotNull()
    checks = [
        ("error", ~good, "date is not YYYY-MM-DD"), ("error", F.col("again"), "duplicate meeting date"), ("warning", good & ~F.col("day").between(first, last), "outside the sample"),
        ("error", good & (F.weekday("day") >= 5), "weekend"), ("error", good & ~st.rlike(HHMM), "statement_time_et is not HH:MM"), ("error", good & (pc != "") & ~pc.rlike(HHMM), "press_conference_time_et is not HH:MM"),
        ("error", good & (pc != "") & st.rlike(HHMM) & (pc <= st), "press conference is not after the statement"), ("error", good & ~F.col("source_url").rlike(WEB), "source_url is not an http(s) link"),
    ]
    return _faults(d, row, checks)


def _faults(d: DataFrame, row: str, checks: list[tuple[str, Column, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("fault"))) for s, c, m in checks]))
    return d.select(row, F.explode(found).alias("f")).select(row, "f.*")


def surprise_faults(entries: DataFrame, row: str, known: DataFrame | None, first: str, last: str, variables: dict = VARIABLES) -> DataFrame:
    """Faults of surprise rows, all columns text: row, severity ("error", "warning"), fault.

    known: event_id of the calendar, or None to leave that check out. A row whose release_date can't be read is judged no
    further than that; plausibility and decimals are judged on rows without a graver fault.
    """
    cols = ("event_id", "event_type", "release_date", "variable", "actual", "consensus", "prior", "unit", "source_url")
    d = entries.select(row, *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols])
    d = d.withColumn("day", F.when(F.col("release_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("release_date")).try_cast("date"))
    spec = F.create_map(*[x for k, v in variables.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("type"), F.lit(v[1]).alias("unit"), F.lit(v[3]).alias("decimals"), F.lit(v[4]).alias("lo"), F.lit(v[5]).alias("hi")))])
    d = d.withColumn("v", spec[F.col("variable")])
    for k in ("actual", "consensus", "prior"):
        d = d.withColumn(f"n_{k}", F.when(F.col(k) != "", F.regexp_replace(k, ",", "")).try_cast("double"))
    before = F.count("*").over(Window.partitionBy("event_id", "variable").orderBy(row).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("again", before > 0)
    if known is not None:
        d = d.join(known.select("event_id").distinct().withColumn("is_known", F.lit(True)), "event_id", "left")
    good, v = F.col("day").isNotNull(), F.col("v")
    typed = F.col("event_type").isin("CPI", "NFP")
    grave = ~typed | v.isNull() | (v["type"] != F.col("event_type")) | F.col("n_actual").isNull() | F.col("n_consensus").isNull() | ((F.col("prior") != "") & F.col("n_prior").isNull())
    fine = good & ~F.coalesce(grave, F.lit(True))
    decimals = {k: F.when(F.instr(k, ".") > 0, F.length(F.substring_index(k, ".", -1))).otherwise(0) for k in ("actual", "consensus")}
    checks = [
        ("error", ~typed, "event_type must be CPI or NFP"), ("error", v.isNull(), "unknown variable"), ("error", v["type"] != F.col("event_type"), "variable of another event type"),
        ("error", ~good, "release_date is not YYYY-MM-DD"), ("error", good & ~F.col("day").between(first, last), "release_date outside the sample"),
        ("error", good & typed & (F.col("event_id") != F.concat_ws("_", "event_type", F.date_format("day", "yyyy-MM-dd"))), "event_id does not fit type and date"),
        ("error", good & F.col("again"), "duplicate row"), *[("error", good & (F.col(k) == ""), f"{k} is missing") for k in ("actual", "consensus")],
        *[("error", good & (F.col(k) != "") & F.col(f"n_{k}").isNull(), f"{k} is not a number") for k in ("actual", "consensus", "prior")],
        ("error", good & (F.col("unit") != v["unit"]), "wrong unit"), ("error", good & ~F.col("source_url").rlike(WEB), "source_url is not an http(s) link"),
        *[("warning", fine & ~F.col(f"n_{k}").between(v["lo"], v["hi"]), f"{k} is outside the plausible range") for k in ("actual", "consensus")],
        *[("warning", fine & (decimals[k] > v["decimals"] + 1), f"{k} has more decimals than published") for k in ("actual", "consensus")],
    ]
    if known is not None:
        checks.append(("error", good & F.col("is_known").isNull(), "event is not in the calendar"))
    return _faults(d, row, checks)


def missing_primary(entries: DataFrame, events: DataFrame, variables: dict = VARIABLES) -> DataFrame:
    """Events of the calendar without a row of their type's primary variable: event_type, missing, first_six."""
    primary = {v[0]: k for k, v in variables.items() if v[2]}
    want = F.create_map(*[F.lit(x) for kv in primary.items() for x in kv])
    need = events.filter(F.col("event_type").isin(*primary)).select("event_id", "event_type", want[F.col("event_type")].alias("variable")).distinct()
    lack = need.join(entries.select("event_id", "variable"), ["event_id", "variable"], "left_anti")
    w = Window.partitionBy("event_type").orderBy("event_id")
    ranked = lack.withColumn("r", F.row_number().over(w))
    six = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 6, F.struct("r", "event_id")))), lambda x: x["event_id"]), ", ")
    return ranked.groupBy("event_type").agg(F.count("*").alias("missing"), six.alias("first_six"))


def published_values(vintages: DataFrame, releases: DataFrame, keys: list[str]) -> DataFrame:
    """First published figure of each release: keys, release_date, month, level, change, pct_change.

    vintages: keys, realtime_start, date, value; releases: keys, release_date. The reference month is the latest of that day's
    vintage; its value and that of the month before are the latest known on the day. Without a vintage that day: NULL.
    """
    r = releases.select(*keys, "release_date").distinct()
    of_day = vintages.withColumnRenamed("realtime_start", "release_date").groupBy(*keys, "release_date").agg(F.max("date").alias("month"))
    r = r.join(of_day, [*keys, "release_date"], "left").withColumn("before", F.add_months(F.trunc("month", "MM"), -1))
    # Equi-join on the month, then the latest vintage up to the day.
    want = r.select(*keys, "release_date", F.explode(F.array(F.struct(F.col("month").alias("date"), F.lit(1).alias("is_now")), F.struct(F.col("before").alias("date"), F.lit(0).alias("is_now")))).alias("w")).select(*keys, "release_date", "w.*")
    v = want.join(vintages, [*keys, "date"]).filter("realtime_start <= release_date")
    latest = v.groupBy(*keys, "release_date").agg(
        F.max_by(F.when(F.col("is_now") == 1, F.col("value")), F.when(F.col("is_now") == 1, F.struct("realtime_start", "value"))).alias("now"),
        F.max_by(F.when(F.col("is_now") == 0, F.col("value")), F.when(F.col("is_now") == 0, F.struct("realtime_start", "value"))).alias("prev"),
    )
    out = r.join(latest, [*keys, "release_date"], "left")
    return out.select(*keys, "release_date", "month", F.col("now").alias("level"), (F.col("now") - F.col("prev")).alias("change"), ((F.try_divide("now", "prev") - 1) * 100).alias("pct_change"))


def cross_check(entries: DataFrame, published: Column, decimals: Column) -> DataFrame:
    """Entries with alfred_rounded and status: ok within half a unit of the last decimal, MISMATCH, or no vintage."""
    scale = F.pow(F.lit(10.0), decimals)
    rounded = F.rint(published * scale) / scale
    close = F.abs(rounded - F.col("actual")) <= 0.5 / scale + 1e-9
    return entries.withColumns({"alfred_rounded": rounded, "status": F.when(published.isNull(), "no vintage on the release date").when(close, "ok").otherwise("MISMATCH")})
