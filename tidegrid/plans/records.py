"""Queries of records, calendars, quality, costs and replay, on the tables of the domain and the tape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.clock import et_to_utc_ns, group_label
from tidegrid.operators import calendar, costplan, quality, regression
from tidegrid.plans.study import ET_HOURS, rounded, with_steps
from tidegrid.sources import records, tape
from tidegrid.sources.delimited import SURPRISE_FIELDS, Field, load_lines
from tidegrid.sources.tables import table
from tidegrid.streaming import replay

QUERIES: dict = {}
SQL: dict[str, str] = {}
NS = 10**9
_SERIES = ["window_id", "stage", "instrument"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Quality


def _quality(spark, folder) -> DataFrame:
    ticks = table(spark, folder, "book_updates").drop("received_at")
    windows = table(spark, folder, "stages").dropna(subset=["window_id", "stage"]).groupBy("window_id", "stage").agg(F.min("t0_ns").alias("t0_ns"))
    windows = windows.select("window_id", "stage", "t0_ns", (F.col("t0_ns") - 65 * NS).alias("start_ns"), (F.col("t0_ns") + 120 * NS).alias("end_ns"))
    return quality.check_windows(ticks, windows, _SERIES, (-5, 10))


_Q = """WITH s AS (SELECT window_id, stage, min(t0_ns) AS t0 FROM stages GROUP BY ALL),
b AS (SELECT u.* EXCLUDE received_at, t0, t0 - 65000000000 AS a, t0 + 120000000000 AS z FROM book_updates u JOIN s USING (window_id, stage)),
counts AS (SELECT window_id, stage, instrument, count(*) AS rows, count(*) FILTER (ts_event < prev) AS out_of_order_timestamps, count(*) FILTER (bid_px_0 > ask_px_0) AS crossed_book_rows, count(*) FILTER (bid_px_0 = ask_px_0) AS locked_book_rows,
    count(*) FILTER (bid_px_0 IS NULL OR ask_px_0 IS NULL) AS one_sided_rows, count(*) FILTER (coalesce(least(bid_sz_0, ask_sz_0) < 0, false) OR coalesce(action IN (3, 4) AND size <= 0, false)) AS bad_size_rows,
    greatest(0.0, (min(ts_event) - any_value(a)) / 1e9) AS starts_late_s, greatest(0.0, (any_value(z) - max(ts_event)) / 1e9) AS ends_early_s
    FROM (SELECT *, lag(ts_event) OVER (PARTITION BY window_id, stage, instrument ORDER BY seq) AS prev FROM b) GROUP BY ALL),
twins AS (SELECT window_id, stage, instrument, CAST(sum(n) AS BIGINT) // 2 AS d FROM (SELECT COLUMNS(* EXCLUDE (t0, a, z)), count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
gap AS (SELECT window_id, stage, instrument, max(p - q) / 1e9 AS max_gap_s FROM (SELECT *, lag(p) OVER (PARTITION BY window_id, stage, instrument ORDER BY p) AS q FROM
    (SELECT window_id, stage, instrument, ts_event AS p FROM b WHERE ts_event BETWEEN a AND z UNION SELECT window_id, stage, instrument, unnest([a, z]) FROM b)) GROUP BY ALL),
core AS (SELECT window_id, stage, instrument, max(p - q) / 1e9 AS max_gap_core_s FROM (SELECT *, lag(p) OVER (PARTITION BY window_id, stage, instrument ORDER BY p) AS q FROM
    (SELECT window_id, stage, instrument, ts_event AS p FROM b WHERE ts_event BETWEEN t0 - 5000000000 AND t0 + 10000000000 UNION SELECT window_id, stage, instrument, unnest([t0 - 5000000000, t0 + 10000000000]) FROM b)) GROUP BY ALL),
q AS (SELECT c.*, coalesce(d, 0) AS duplicate_records, max_gap_s, max_gap_core_s FROM counts c LEFT JOIN twins USING (window_id, stage, instrument) JOIN gap USING (window_id, stage, instrument) JOIN core USING (window_id, stage, instrument))"""


@query(_Q + """ SELECT window_id, stage, instrument, rows, out_of_order_timestamps, crossed_book_rows, locked_book_rows, one_sided_rows, bad_size_rows, duplicate_records, round(starts_late_s, 6) AS starts_late_s, round(ends_early_s, 6) AS ends_early_s,
round(max_gap_s, 6) AS max_gap_s, round(max_gap_core_s, 6) AS max_gap_core_s FROM q""")
def quality_window_counts(spark, folder):
    return _quality(spark, folder)


@query(_Q + """ SELECT window_id, stage, instrument, CASE WHEN crossed_book_rows > 0 OR max_gap_core_s > 5 THEN 'reject' WHEN out_of_order_timestamps > 0 OR duplicate_records > 0 OR bad_size_rows > 0 OR max_gap_s > 5 THEN 'warn' ELSE 'ok' END AS status,
CASE WHEN crossed_book_rows > 0 OR max_gap_core_s > 5 THEN array_to_string(list_filter([CASE WHEN crossed_book_rows > 0 THEN crossed_book_rows || ' crossed-book rows' END, CASE WHEN max_gap_core_s > 5 THEN 'silence around the release' END], lambda x: x IS NOT NULL), '; ')
ELSE array_to_string(list_filter([CASE WHEN out_of_order_timestamps > 0 THEN 'records out of order' END, CASE WHEN duplicate_records > 0 THEN duplicate_records || ' duplicate records' END, CASE WHEN bad_size_rows > 0 THEN bad_size_rows || ' rows with impossible sizes' END,
CASE WHEN max_gap_s > 5 THEN 'gap' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM q""")
def quality_status(spark, folder):
    v = quality.verdict(_quality(spark, folder))
    text = F.array_join("reasons", "; ")
    text = F.regexp_replace(F.regexp_replace(text, r"[0-9.]+ s without data around the release", "silence around the release"), r"[0-9.]+ s gap away from the release", "gap")
    return v.select(*_SERIES, "status", text.alias("reasons"))


@query("""SELECT DISTINCT instrument, event_date, date_diff('day', event_date, last_day(event_date)) AS days, coalesce(date_diff('day', event_date, last_day(event_date)) BETWEEN 0 AND CASE instrument WHEN 'ES' THEN 12 WHEN 'CL' THEN 10 WHEN '6E' THEN 12 WHEN '6J' THEN 12
WHEN 'SR3' THEN 12 WHEN 'ZT' THEN 35 WHEN 'ZF' THEN 35 WHEN 'ZN' THEN 35 WHEN 'ZB' THEN 35 WHEN 'GC' THEN 35 END, false) AS roll_week FROM requests JOIN stages USING (window_id)""")
def roll_week_flag(spark, folder):
    """Roll period by instrument and day, the month's last day standing for the expiration."""
    d = table(spark, folder, "requests").join(table(spark, folder, "stages"), "window_id").select("instrument", "event_date").distinct()
    days = F.datediff(F.last_day("event_date"), "event_date").cast("long")
    return d.select("instrument", "event_date", days.alias("days"), quality.roll_week(days, F.col("instrument")).alias("roll_week"))


# Records


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(round_even(CAST(round(l_extendedprice * 100) AS BIGINT) * 10000000 * 1e-9 / 0.015625, 0) AS BIGINT) END AS ticks FROM lineitem""")
def fixed_point_ticks(spark, folder):
    """Prices as fixed-point records in ticks of 1/64; line 7 carries the undefined price."""
    fixed = F.when(F.col("l_linenumber") == 7, F.lit(2**63 - 1)).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long") * 10_000_000)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", records.to_ticks(fixed, F.lit(0.015625)).alias("ticks"))


@query("""SELECT o_custkey AS instrument_id, arg_max(o_orderpriority, o_orderkey) AS raw_symbol, round(arg_max(CAST(o_totalprice AS BIGINT), o_orderkey) * 1e-9, 12) * 1e6 AS tick_micro, max(o_orderkey) AS expiration_ns FROM orders GROUP BY ALL""")
def definitions_keep_last(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("instrument_id"), F.col("o_orderpriority").alias("raw_symbol"), F.rint("o_totalprice").cast("long").alias("min_price_increment"), F.lit(0).alias("unit_of_measure_qty"), F.col("o_orderkey").alias("expiration"), "o_orderkey")
    d = records.definitions(o, "o_orderkey")
    return d.select("instrument_id", "raw_symbol", (F.round("tick_size", 12) * 1e6).alias("tick_micro"), "expiration_ns")


# Calendar


@query(f"""SELECT CAST(day AS DATE) AS day, time_et, (epoch_us(day) // 60000000 + minutes + 60 * {ET_HOURS.format(d='CAST(day AS DATE)')}) * 60000000000 AS t0_ns
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) AS g(day), (VALUES ('08:30', 510), ('14:00', 840)) v(time_et, minutes)""")
def calendar_dst_t0(spark, folder):
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2026-12-31')) AS day")
    d = days.select("day", F.explode(F.array(F.lit("08:30"), F.lit("14:00"))).alias("time_et"))
    return d.select("day", "time_et", et_to_utc_ns(F.col("day"), F.col("time_et")).alias("t0_ns"))


def _events(spark, folder):
    s = table(spark, folder, "stages").filter("event_id is not null and event_type <> 'CONTROL'")
    return s.groupBy("event_type", F.col("event_date").alias("date"), "stage", "time_et").agg(F.min("tier").alias("tier"), F.min("source").alias("source"))


@query("""SELECT event_type || '_' || strftime(event_date, '%Y-%m-%d') AS event_id, event_type, min(tier) AS tier, event_date AS date, stage, time_et, min(t0_ns) AS t0_utc_ns, min(source) AS source FROM stages WHERE event_id IS NOT NULL AND event_type <> 'CONTROL' GROUP BY event_type, event_date, stage, time_et""")
def build_calendar(spark, folder):
    return calendar.calendar(_events(spark, folder)).drop("t0_utc")


@query("""WITH c AS (SELECT DISTINCT window_id AS control_id, time_et, t0_ns FROM stages WHERE event_type = 'CONTROL' AND stage = 'control')
SELECT event_type || '_' || strftime(event_date, '%Y-%m-%d') AS window_id, event_type, stage, time_et, min(t0_ns) AS t0_ns FROM stages WHERE event_id IS NOT NULL AND event_type <> 'CONTROL' GROUP BY ALL
UNION ALL SELECT control_id, 'CONTROL', 'control', time_et, t0_ns FROM c UNION ALL SELECT control_id, 'CONTROL', 'control_1430', '14:30', t0_ns + 1800000000000 FROM c WHERE time_et = '14:00'""".replace("GROUP BY ALL\nUNION", "GROUP BY event_type, event_date, stage, time_et\nUNION"))
def stage_expansion(spark, folder):
    c = table(spark, folder, "stages").filter("event_type = 'CONTROL' and stage = 'control'").select(F.col("window_id").alias("control_id"), "time_et", F.col("t0_ns").alias("t0_utc_ns")).distinct()
    return calendar.expand_stages(calendar.calendar(_events(spark, folder)), c)


#: The twelve rules of the closed and thin days in SQL, for the years given.
_HOLIDAYS = """y AS (SELECT CAST(y AS INTEGER) AS y FROM generate_series({first}, {last}) AS s(y)),
g AS (SELECT y, y % 19 + 1 AS gold, (3 * (y // 100 + 1)) // 4 - 12 AS leaps, (8 * (y // 100 + 1) + 5) // 25 - 5 AS moon FROM y),
ep AS (SELECT *, (11 * gold + 20 + moon - leaps) % 30 AS e0 FROM g), ef AS (SELECT *, 44 - (e0 + CASE WHEN e0 = 24 OR (e0 = 25 AND gold > 11) THEN 1 ELSE 0 END) AS n0 FROM ep),
ea AS (SELECT y, leaps, n0 + CASE WHEN n0 < 21 THEN 30 ELSE 0 END AS n FROM ef), easter AS (SELECT y, make_date(y, 3, 1) + CAST(n + 6 - ((5 * y) // 4 - leaps - 10 + n) % 7 AS INTEGER) AS d FROM ea),
nth(name, m, wd, n, later) AS (VALUES ('Martin Luther King Jr. Day', 1, 1, 3, 0), ('Presidents'' Day', 2, 1, 3, 0), ('Labor Day', 9, 1, 1, 0), ('Thanksgiving', 11, 4, 4, 0), ('Day after Thanksgiving', 11, 4, 4, 1)),
obs(name, m, d) AS (VALUES ('New Year''s Day', 1, 1), ('Juneteenth', 6, 19), ('Independence Day', 7, 4), ('Christmas Day', 12, 25)),
holiday AS (SELECT make_date(y, m, 1) + CAST((wd - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) + later AS INTEGER) AS date, name FROM y, nth
    UNION ALL SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER), 'Memorial Day' FROM y
    UNION ALL SELECT make_date(y, m, d) + CASE isodow(make_date(y, m, d)) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END, name FROM y, obs
    UNION ALL SELECT d - 2, 'Good Friday' FROM easter UNION ALL SELECT make_date(y, 12, 24), 'Christmas Eve' FROM y)"""


@query(f"WITH {_HOLIDAYS.format(first=2024, last=2026)} SELECT CAST(date AS DATE) AS date, name FROM holiday")
def holiday_table(spark, folder):
    return calendar.holiday_table(spark, 2024, 2026)


@query("""WITH w AS (SELECT time_et, CAST(isodow(event_date) - 1 AS INTEGER) AS weekday, count(*) AS weight FROM (SELECT DISTINCT event_date, time_et FROM stages WHERE event_type <> 'CONTROL') GROUP BY ALL),
x AS (SELECT *, 7 * weight / CAST(sum(weight) OVER (PARTITION BY time_et) AS DOUBLE) AS exact FROM w), f AS (SELECT *, floor(exact + 1e-9) AS fl, round(exact - floor(exact + 1e-9), 9) AS r FROM x)
SELECT time_et, weekday, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY time_et ORDER BY r DESC, weight DESC, weekday) <= 7 - sum(fl) OVER (PARTITION BY time_et) THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""")
def largest_remainder(spark, folder):
    d = table(spark, folder, "stages").filter("event_type <> 'CONTROL'").select("event_date", "time_et").distinct()
    return calendar.apportion(d.groupBy("time_et", F.weekday("event_date").alias("weekday")).agg(F.count("*").alias("weight")), ["time_et"], "weekday", "weight", F.lit(7))


@query(f"""WITH {_HOLIDAYS.format(first=2024, last=2024)}, wanted(time_et, n) AS (VALUES ('08:30', 30), ('14:00', 15)), ev AS (SELECT DISTINCT time_et, event_date AS date, tier FROM stages WHERE event_type <> 'CONTROL'),
cand AS (SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) AS s(d)),
pool AS (SELECT w.time_et, w.n, c.date, CAST(isodow(c.date) - 1 AS INTEGER) AS weekday, (date_diff('day', DATE '1970-01-01', c.date) * 7919 + 20241001) * 48271 % 2147483647 AS draw FROM cand c, wanted w
    WHERE isodow(c.date) < 6 AND NOT EXISTS (SELECT 1 FROM holiday h WHERE h.date = c.date) AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.time_et = w.time_et AND ev.date = c.date)),
wt AS (SELECT time_et, CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(*) AS weight FROM ev WHERE tier = 1 AND isodow(date) < 6 GROUP BY ALL),
ex AS (SELECT wt.*, n, n * weight / CAST(sum(weight) OVER (PARTITION BY time_et) AS DOUBLE) AS exact FROM wt JOIN wanted USING (time_et)), fl AS (SELECT *, floor(exact + 1e-9) AS f, round(exact - floor(exact + 1e-9), 9) AS r FROM ex),
plan AS (SELECT time_et, weekday, f + CASE WHEN row_number() OVER (PARTITION BY time_et ORDER BY r DESC, weight DESC, weekday) <= n - sum(f) OVER (PARTITION BY time_et) THEN 1 ELSE 0 END AS share FROM fl),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.time_et, p.weekday ORDER BY draw, date) <= coalesce(share, 0) AS chosen FROM pool p LEFT JOIN plan USING (time_et, weekday)),
filled AS (SELECT *, n - sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (PARTITION BY time_et) AS short, row_number() OVER (PARTITION BY time_et, chosen ORDER BY draw, date) AS rest FROM ranked)
SELECT 'CONTROL' || replace(time_et, ':', '') || '_' || strftime(date, '%Y-%m-%d') AS control_id, time_et, date, strftime(date, '%a') AS weekday,
    (date_diff('day', DATE '1970-01-01', date) * 1440 + CAST(substr(time_et, 1, 2) AS BIGINT) * 60 + CAST(substr(time_et, 4, 2) AS BIGINT) + 60 * {ET_HOURS.format(d='date')}) * 60000000000 AS t0_utc_ns FROM filled WHERE chosen OR rest <= short""")
def control_days(spark, folder):
    events = table(spark, folder, "stages").filter("event_type <> 'CONTROL'").select("time_et", F.col("event_date").alias("date"), "tier").distinct()
    candidates = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-12-31')) AS date")
    wanted = spark.createDataFrame([("08:30", 30), ("14:00", 15)], "time_et string, n int")
    days = calendar.control_days(candidates, events, calendar.holiday_table(spark, 2024, 2024), events.filter("tier = 1"), wanted, 20241001)
    return calendar.control_windows(days)


_SPLIT = "SELECT line_id, str_split(line, ',') AS f FROM surprise_lines WHERE line_no <> 1 AND line NOT LIKE '%\"%'"
_VAR = "CASE variable WHEN 'core_cpi_mom' THEN 'CPI' WHEN 'headline_cpi_mom' THEN 'CPI' WHEN 'nfp_change' THEN 'NFP' WHEN 'unemployment_rate' THEN 'NFP' WHEN 'ahe_mom' THEN 'NFP' END"


@query(f"""WITH s AS ({_SPLIT}), t AS (SELECT line_id, trim(f[1]) AS event_id, trim(f[2]) AS event_type, trim(f[3]) AS release_date, trim(f[4]) AS variable, trim(f[5]) AS actual, trim(f[6]) AS consensus, trim(f[7]) AS prior, trim(f[8]) AS unit, trim(f[9]) AS source_url FROM s WHERE len(f) = 10),
v AS (SELECT *, {_VAR} AS vt, CASE variable WHEN 'nfp_change' THEN 'thousands' ELSE 'pct' END AS vu, CASE variable WHEN 'nfp_change' THEN 0 ELSE 1 END AS vd,
    CASE variable WHEN 'core_cpi_mom' THEN -1.5 WHEN 'headline_cpi_mom' THEN -2.0 WHEN 'nfp_change' THEN -1500 WHEN 'unemployment_rate' THEN 2 ELSE -1 END AS lo, CASE variable WHEN 'core_cpi_mom' THEN 2.0 WHEN 'headline_cpi_mom' THEN 2.5 WHEN 'nfp_change' THEN 1500 WHEN 'unemployment_rate' THEN 15 ELSE 2 END AS hi,
    CASE WHEN regexp_matches(release_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(release_date AS DATE) END AS d, TRY_CAST(nullif(actual, '') AS DOUBLE) AS na, TRY_CAST(nullif(consensus, '') AS DOUBLE) AS nc, TRY_CAST(nullif(prior, '') AS DOUBLE) AS np,
    count(*) OVER (PARTITION BY event_id, variable ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS again FROM t),
c AS (SELECT *, d IS NOT NULL AS good, event_type IN ('CPI', 'NFP') AS typed FROM v),
g AS (SELECT *, good AND typed AND vt IS NOT NULL AND vt = event_type AND na IS NOT NULL AND nc IS NOT NULL AND (prior = '' OR np IS NOT NULL) AS fine FROM c)
SELECT line_id, s.severity, s.fault FROM (SELECT line_id, unnest([CASE WHEN NOT typed THEN struct_pack(severity := 'error', fault := 'event_type must be CPI or NFP') END, CASE WHEN vt IS NULL THEN struct_pack(severity := 'error', fault := 'unknown variable') END,
CASE WHEN vt <> event_type THEN struct_pack(severity := 'error', fault := 'variable of another event type') END, CASE WHEN NOT good THEN struct_pack(severity := 'error', fault := 'release_date is not YYYY-MM-DD') END,
CASE WHEN good AND d NOT BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' THEN struct_pack(severity := 'error', fault := 'release_date outside the sample') END, CASE WHEN good AND typed AND event_id <> event_type || '_' || strftime(d, '%Y-%m-%d') THEN struct_pack(severity := 'error', fault := 'event_id does not fit type and date') END,
CASE WHEN good AND again > 0 THEN struct_pack(severity := 'error', fault := 'duplicate row') END, CASE WHEN good AND actual = '' THEN struct_pack(severity := 'error', fault := 'actual is missing') END, CASE WHEN good AND consensus = '' THEN struct_pack(severity := 'error', fault := 'consensus is missing') END,
CASE WHEN good AND actual <> '' AND na IS NULL THEN struct_pack(severity := 'error', fault := 'actual is not a number') END, CASE WHEN good AND consensus <> '' AND nc IS NULL THEN struct_pack(severity := 'error', fault := 'consensus is not a number') END, CASE WHEN good AND prior <> '' AND np IS NULL THEN struct_pack(severity := 'error', fault := 'prior is not a number') END,
CASE WHEN good AND vt IS NOT NULL AND unit <> vu THEN struct_pack(severity := 'error', fault := 'wrong unit') END, CASE WHEN good AND NOT regexp_matches(source_url, '^https?://\\S+') THEN struct_pack(severity := 'error', fault := 'source_url is not an http(s) link') END,
CASE WHEN fine AND na NOT BETWEEN lo AND hi THEN struct_pack(severity := 'warning', fault := 'actual is outside the plausible range') END, CASE WHEN fine AND nc NOT BETWEEN lo AND hi THEN struct_pack(severity := 'warning', fault := 'consensus is outside the plausible range') END,
CASE WHEN fine AND (CASE WHEN contains(actual, '.') THEN length(str_split(actual, '.')[-1]) ELSE 0 END) > vd + 1 THEN struct_pack(severity := 'warning', fault := 'actual has more decimals than published') END,
CASE WHEN fine AND (CASE WHEN contains(consensus, '.') THEN length(str_split(consensus, '.')[-1]) ELSE 0 END) > vd + 1 THEN struct_pack(severity := 'warning', fault := 'consensus has more decimals than published') END]) AS s FROM g) WHERE s IS NOT NULL""")
def validate_surprise_rows(spark, folder):
    """Faults of the unquoted ten-field lines of the hand-typed files, as its SQL has them; validate_surprise_lines judges all."""
    lines = table(spark, folder, "surprise_lines").filter("line_no <> 1 and instr(line, '\"') = 0").select("line_id", F.split("line", ",", -1).alias("f")).filter("size(f) = 10")
    names = ["event_id", "event_type", "release_date", "variable", "actual", "consensus", "prior", "unit", "source_url", "notes"]
    return calendar.surprise_faults(lines.select("line_id", *[F.col("f")[i].alias(n) for i, n in enumerate(names)]), "line_id", None, "2024-01-01", "2024-12-31")


@query()
def validate_surprise_lines(spark, folder):
    """Faults of all lines of the hand-typed files that hold ten fields, quoted or not, and of events that stages lacks.

    Lines without ten soundly quoted fields have no row to judge; p5_reasons names them.
    """
    as_text = tuple(Field(f.name) for f in SURPRISE_FIELDS)
    rows = load_lines(table(spark, folder, "surprise_lines"), "line", as_text, keep=("line_id",), header="line_no").filter("reason is null")
    known = table(spark, folder, "stages").filter("event_id is not null").select("event_id")
    return calendar.surprise_faults(rows.drop("reason"), "line_id", known, "2024-01-01", "2024-12-31")


def _meetings(spark, folder):
    s = table(spark, folder, "stages").filter("event_type = 'FOMC'").select("stage_id", "event_date").distinct()
    k = F.col("stage_id") % 7
    return s.select(
        "stage_id", F.when(k == 1, F.lit("soon")).otherwise(F.date_format(F.when(k == 2, F.date_add(F.date_trunc("week", "event_date").cast("date"), 5)).otherwise(F.col("event_date")), "yyyy-MM-dd")).alias("date"),
        F.when(k == 3, "2 pm").otherwise("14:00").alias("statement_time_et"), F.when(k == 4, "13:30").when(k == 5, "").otherwise("14:30").alias("press_conference_time_et"), F.when(k == 6, "none").otherwise("https://board.example/statement").alias("source_url"),
    )


@query("""WITH s AS (SELECT DISTINCT stage_id, event_date, stage_id % 7 AS k FROM stages WHERE event_type = 'FOMC'), m AS (SELECT stage_id, k, CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN CAST(date_trunc('week', event_date) + INTERVAL 5 DAY AS DATE) ELSE event_date END AS d FROM s),
c AS (SELECT *, d IS NOT NULL AND count(*) OVER (PARTITION BY d ORDER BY stage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS again FROM m)
SELECT stage_id, s.severity, s.fault FROM (SELECT stage_id, unnest([CASE WHEN d IS NULL THEN struct_pack(severity := 'error', fault := 'date is not YYYY-MM-DD') END, CASE WHEN again THEN struct_pack(severity := 'error', fault := 'duplicate meeting date') END,
CASE WHEN d NOT BETWEEN DATE '2024-01-01' AND DATE '2024-06-30' THEN struct_pack(severity := 'warning', fault := 'outside the sample') END, CASE WHEN isodow(d) > 5 THEN struct_pack(severity := 'error', fault := 'weekend') END,
CASE WHEN d IS NOT NULL AND k = 3 THEN struct_pack(severity := 'error', fault := 'statement_time_et is not HH:MM') END, CASE WHEN d IS NOT NULL AND k = 4 THEN struct_pack(severity := 'error', fault := 'press conference is not after the statement') END,
CASE WHEN d IS NOT NULL AND k = 6 THEN struct_pack(severity := 'error', fault := 'source_url is not an http(s) link') END]) AS s FROM c) WHERE s IS NOT NULL""")
def validate_meeting_rows(spark, folder):
    return calendar.meeting_faults(_meetings(spark, folder), "stage_id", "2024-01-01", "2024-06-30")


def _entries(spark, folder):
    return table(spark, folder, "surprises").drop("notes", "source_url", "entered_at").distinct().filter("event_id is not null and release_date is not null and actual is not null and consensus is not null")


_E = "e AS (SELECT DISTINCT entry_id, event_id, event_type, release_date, variable, actual, consensus FROM surprises WHERE event_id IS NOT NULL AND release_date IS NOT NULL AND actual IS NOT NULL AND consensus IS NOT NULL)"


@query(f"WITH {_E} SELECT entry_id, variable, round(actual - consensus, 10) + 0.0 AS surprise, round(round(actual - consensus, 10) / nullif(stddev_samp(round(actual - consensus, 10)) OVER (PARTITION BY variable), 0), 6) + 0.0 AS z FROM e")
def standardise_full(spark, folder):
    return regression.standardised(_entries(spark, folder)).select("entry_id", "variable", "surprise", "z")


@query(f"""WITH {_E}, o AS (SELECT variable, release_date, CAST(min(entry_id) AS VARCHAR) AS event_id, avg(actual) AS actual, avg(consensus) AS consensus FROM e GROUP BY ALL), s AS (SELECT *, round(actual - consensus, 10) AS surprise FROM o),
x AS (SELECT *, stddev_samp(surprise) OVER w AS sd, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY variable ORDER BY release_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT variable, release_date, CASE WHEN n >= 2 AND sd > 1e-9 THEN round(surprise / sd, 6) + 0.0 END AS z FROM x""")
def standardise_expanding(spark, folder):
    one = _entries(spark, folder).groupBy("variable", "release_date").agg(F.min("entry_id").cast("string").alias("event_id"), F.avg("actual").alias("actual"), F.avg("consensus").alias("consensus"))
    return regression.standardised(one, expanding=True).select("variable", "release_date", "z")


@query(f"""WITH {_E}, s AS (SELECT *, round(actual - consensus, 10) AS surprise FROM e), z AS (SELECT *, surprise / nullif(stddev_samp(surprise) OVER (PARTITION BY variable), 0) AS z FROM s)
SELECT event_type, variable, count(*) AS events, round(avg(surprise), 6) + 0.0 AS mean_surprise, round(stddev_samp(surprise), 6) AS sd_surprise, round(min(surprise), 6) AS min_surprise, round(max(surprise), 6) AS max_surprise, count(*) FILTER (abs(z) > 1) AS abs_z_over_1 FROM z GROUP BY ALL""")
def surprise_summary(spark, folder):
    return regression.surprise_summary(regression.standardised(_entries(spark, folder)))


@query(f"""WITH {_E}, have AS (SELECT DISTINCT event_id, variable FROM e), need AS (SELECT DISTINCT event_id, event_type, CASE event_type WHEN 'CPI' THEN 'core_cpi_mom' ELSE 'nfp_change' END AS variable FROM stages WHERE event_type IN ('CPI', 'NFP') AND event_id IS NOT NULL),
lack AS (SELECT * FROM need ANTI JOIN have USING (event_id, variable)) SELECT event_type, count(*) AS missing, string_agg(event_id, ', ' ORDER BY event_id) FILTER (r <= 6) AS first_six FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM lack) GROUP BY ALL""")
def missing_primary(spark, folder):
    return calendar.missing_primary(_entries(spark, folder), table(spark, folder, "stages").filter("event_id is not null"))


def _vintages(spark, folder):
    e = _entries(spark, folder)
    v = e.groupBy("variable", F.col("release_date").alias("realtime_start")).agg(F.max("actual").alias("value"))
    both = F.array(F.struct(F.trunc("realtime_start", "MM").alias("date"), F.col("value").alias("value")), F.struct(F.add_months(F.trunc("realtime_start", "MM"), -1).alias("date"), (F.col("value") + 0.05).alias("value")))
    return v.select("variable", "realtime_start", F.explode(both).alias("b")).select("variable", "realtime_start", "b.*")


_V = f"""{_E}, vint AS (SELECT variable, release_date AS rs, max(actual) AS value FROM e GROUP BY ALL),
v AS (SELECT variable, rs, CAST(date_trunc('month', rs) AS DATE) AS d, value FROM vint UNION ALL SELECT variable, rs, CAST(date_trunc('month', rs) - INTERVAL 1 MONTH AS DATE), value + 0.05 FROM vint),
r AS (SELECT DISTINCT variable, rs AS release_date, CAST(date_trunc('month', rs) AS DATE) AS month FROM vint),
p AS (SELECT r.variable, r.release_date, r.month, arg_max(v.value, v.rs) FILTER (v.d = r.month) AS level, arg_max(v.value, v.rs) FILTER (v.d = CAST(r.month - INTERVAL 1 MONTH AS DATE)) AS prev FROM r JOIN v ON v.variable = r.variable AND v.rs <= r.release_date GROUP BY ALL)"""


@query(f"WITH {_V} SELECT variable, release_date, month, round(level, 6) + 0.0 AS level, round(level - prev, 6) + 0.0 AS change, round((level / nullif(prev, 0) - 1) * 100, 6) + 0.0 AS pct_change FROM p")
def vintage_asof_published(spark, folder):
    v = _vintages(spark, folder)
    return calendar.published_values(v, _entries(spark, folder).select("variable", "release_date"), ["variable"])


@query(f"""WITH {_V} SELECT entry_id, round(round_even(level, 1), 6) + 0.0 AS alfred_rounded, CASE WHEN abs(round_even(level, 1) - actual) <= 0.05 + 1e-9 THEN 'ok' ELSE 'MISMATCH' END AS status FROM e JOIN p USING (variable, release_date)""".replace("round_even(level, 1)", "round_even(level * 10, 0) / 10"))
def vintage_cross_check(spark, folder):
    e = _entries(spark, folder)
    p = calendar.published_values(_vintages(spark, folder), e.select("variable", "release_date"), ["variable"])
    return calendar.cross_check(e.join(p, ["variable", "release_date"], "left"), F.col("level"), F.lit(1)).select("entry_id", "alfred_rounded", "status")


# Requests and their cost


def _windows(spark, folder):
    cal = table(spark, folder, "stages").select(F.col("window_id").alias("event_id"), "event_type", F.col("event_date").alias("date"), F.col("t0_ns").alias("t0_utc_ns"))
    return costplan.event_windows(cal)


_W = "w AS (SELECT window_id, event_type AS kind, min(t0_ns) AS a, max(t0_ns) AS z, min(event_date) AS date FROM stages GROUP BY window_id, event_type)"
_SCHEMAS = [("ohlcv-1s", -7200, 14400, False), ("mbp-1", -1800, 3600, False), ("mbp-10", -300, 900, True)]


@query(f"""WITH {_W}, i AS (SELECT * FROM (VALUES ('ZN', true), ('ES', true), ('GC', false)) x(instrument, deep)), s AS (SELECT * FROM (VALUES ('ohlcv-1s', -7200, 14400, false), ('mbp-1', -1800, 3600, false), ('mbp-10', -300, 900, true)) x(feed_schema, lo, hi, nd))
SELECT instrument, feed_schema, window_id, a + CAST(lo AS BIGINT) * 1000000000 AS start_ns, z + CAST(hi AS BIGINT) * 1000000000 AS end_ns FROM w, i, s WHERE deep OR NOT nd UNION ALL
SELECT instrument, 'definition', strftime(date, '%Y-%m-%d'), min(a) // 86400000000000 * 86400000000000, min(a) // 86400000000000 * 86400000000000 + 86400000000000 FROM w, i GROUP BY instrument, date""")
def request_plan(spark, folder):
    instruments = spark.createDataFrame([("ZN", True), ("ES", True), ("GC", False)], "instrument string, deep boolean")
    return costplan.requests(_windows(spark, folder), instruments, spark.createDataFrame(_SCHEMAS, "feed_schema string, lo_s long, hi_s long, deep boolean"))


#: Parameters of the cost plan: instruments (deep, core), windows by schema with their short forms, and quotes of sample windows.
_INSTRUMENTS = [("ZN", True, True), ("ES", True, False), ("GC", False, False)]
_PLAN_SCHEMAS = [("ohlcv-1s", -7200, 14400, None, None, False), ("mbp-1", -1800, 3600, -600, 1800, False), ("mbp-10", -300, 900, None, None, True)]
_QUOTES = [("ZN", "ohlcv-1s", "s1", 21600.0, 0.02), ("ZN", "ohlcv-1s", "s2", 21600.0, 0.025), ("ES", "ohlcv-1s", "s1", 21600.0, 0.04), ("GC", "ohlcv-1s", "s1", 21600.0, 0.01), ("ZN", "mbp-1", "s1", 5400.0, 0.05), ("ZN", "mbp-1", "s2", 5400.0, 0.06), ("ES", "mbp-1", "s1", 5400.0, 0.075), ("GC", "mbp-1", "s1", 5400.0, 0.02), ("ZN", "mbp-10", "s1", 1200.0, 0.0), ("ES", "mbp-10", "s1", 1200.0, 0.3), ("ZN", "mbp-10", "s2", 1200.0, 0.2)]
_FEWER = 3


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if not isinstance(v, bool) else str(v).lower() for v in r) + ")" for r in rows)


_COST = f"""{_W}, q(instrument, feed_schema, window_id, seconds, cost) AS (VALUES {_values(_QUOTES)}), i(instrument, deep, core) AS (VALUES {_values(_INSTRUMENTS)}), s(feed_schema, lo, hi, slo, shi, nd) AS (VALUES {_values(_PLAN_SCHEMAS)}),
own AS (SELECT feed_schema, CAST(sum(cost) AS DOUBLE) / sum(seconds) AS rate FROM q WHERE instrument = 'ZN' GROUP BY ALL),
rates AS (SELECT feed_schema, 'ZN' AS instrument, rate FROM own UNION ALL SELECT a.feed_schema, a.instrument, any_value(o.rate) * arg_min(CASE WHEN r.cost > 0 THEN CAST(a.cost AS DOUBLE) / r.cost ELSE 1 END, a.window_id)
    FROM q a JOIN q r ON r.instrument = 'ZN' AND r.feed_schema = a.feed_schema AND r.window_id = a.window_id JOIN own o ON o.feed_schema = a.feed_schema WHERE a.instrument <> 'ZN' GROUP BY a.feed_schema, a.instrument),
wk AS (SELECT *, kind <> 'CONTROL' OR row_number() OVER (PARTITION BY kind, a % 86400000000000 ORDER BY a, window_id) <= {_FEWER} AS early FROM w),
opt(option, core, short, few) AS (VALUES ('full plan', 0, 0, 0), ('core instruments only', 1, 0, 0), ('shorter windows', 0, 1, 0), ('fewer control days', 0, 0, 1), ('all three trims', 1, 1, 1)),
c AS (SELECT option, sum(((z - a) / 1e9 + CASE WHEN short = 1 THEN coalesce(shi, hi) - coalesce(slo, lo) ELSE hi - lo END) * rate) AS usd FROM opt, i, s, wk JOIN rates USING (feed_schema, instrument) WHERE (NOT s.nd OR i.deep) AND (opt.core = 0 OR i.core) AND (opt.few = 0 OR wk.early) GROUP BY ALL)"""


@query(f"WITH {_COST.replace('opt, i, s, wk JOIN rates USING (feed_schema, instrument) WHERE', 'opt, i, s, wk, rates r WHERE r.feed_schema = s.feed_schema AND r.instrument = i.instrument AND')} SELECT option, round(usd, 2) AS cost_usd, round(usd, 2) <= 20 AS fits_budget FROM c")
def cost_plan_options(spark, folder):
    """The five options priced from sampled quotes."""
    w = costplan.split_controls(_windows(spark, folder), _FEWER)
    kinds = ["CPI", "NFP", "FOMC", "PPI", "RETAIL", "CLAIMS", "JOLTS", "HOUSING", "ISM", "GDP"]
    instruments = spark.createDataFrame(_INSTRUMENTS, "instrument string, deep boolean, core boolean")
    schemas = spark.createDataFrame(_PLAN_SCHEMAS, "feed_schema string, lo_s long, hi_s long, short_lo_s long, short_hi_s long, deep boolean")
    rates = costplan.sampled_rates(spark.createDataFrame(_QUOTES, "instrument string, feed_schema string, window_id string, seconds double, cost_usd double"), "ZN")
    return costplan.options_table(costplan.estimate(w, costplan.plan_options(instruments, schemas, kinds), rates), 20.0)


@query("""SELECT instrument, feed_schema, window_id, action, round(cost, 6) AS cost_usd, round(spent, 6) AS spent FROM (SELECT *, CASE WHEN have THEN 'cached' WHEN spent <= 5 THEN 'buy' ELSE 'over budget' END AS action FROM (
SELECT *, sum(cost) OVER (ORDER BY start_ns, instrument, feed_schema, window_id ROWS UNBOUNDED PRECEDING) AS spent FROM (SELECT *, CASE WHEN have THEN 0.0 ELSE (end_ns - start_ns) / 1e9 * CASE feed_schema WHEN 'mbp-1' THEN 0.00001 WHEN 'mbp-10' THEN 0.00005 ELSE 0.000002 END END AS cost
FROM (SELECT DISTINCT instrument, feed_schema, window_id, start_ns, end_ns, request_id % 5 = 0 AS have FROM (SELECT instrument, feed_schema, window_id, min(start_ns) AS start_ns, arg_min(end_ns, struct_pack(s := start_ns, e := end_ns, r := request_id)) AS end_ns, arg_min(request_id, struct_pack(s := start_ns, e := end_ns, r := request_id)) AS request_id
    FROM requests WHERE instrument = 'ZN' AND window_id IS NOT NULL AND start_ns IS NOT NULL AND end_ns IS NOT NULL GROUP BY ALL)))))""")
def purchase_plan(spark, folder):
    """A dry run over the requests of one instrument: a fifth is there already, the rest is bought in order until the budget is spent."""
    r = table(spark, folder, "requests").filter("instrument = 'ZN'").dropna(subset=["window_id", "start_ns", "end_ns"]).select("instrument", "feed_schema", "window_id", "start_ns", "end_ns", "request_id")
    r = costplan.first_of(r, ["instrument", "feed_schema", "window_id"], "start_ns", "end_ns", "request_id")
    rates = spark.createDataFrame([(s, "ZN", u) for s, u in (("mbp-1", 0.00001), ("mbp-10", 0.00005), ("ohlcv-1s", 0.000002))], "feed_schema string, instrument string, usd_per_s double")
    todo = costplan.purchases(r.drop("request_id"), r.filter("request_id % 5 = 0"), rates, 5.0)
    return todo.select("instrument", "feed_schema", "window_id", "action", "cost_usd", "spent")


# Replay


def _replay_states(spark, folder):
    t = tape.ticks(spark, folder)
    t0 = tape.stages(spark, folder).groupBy("window_id").agg(F.min("t0_ns").alias("t0_ns"))
    keys = ["window_id", "instrument"]
    d = t.join(t0, "window_id")
    ctx = replay.context(t, d.select(*keys, "t0_ns").distinct(), keys, (-21_600, -7_200), (-43_200, -3_600), 5)
    return replay.states(t, ctx, keys), keys


_CTX = """w0 AS (SELECT window_id, min(t0_ns) AS t0_ns FROM stages_t GROUP BY ALL), o AS (SELECT t.*, t.ts_event - w.t0_ns AS off, bid_sz_0 + ask_sz_0 AS dep FROM ticks t JOIN w0 w USING (window_id)),
ctx AS (SELECT window_id, instrument, CASE WHEN count(*) FILTER (off >= -21600000000000 AND off < -7200000000000) >= 5 THEN median(dep) FILTER (off >= -21600000000000 AND off < -7200000000000)
WHEN count(*) FILTER (off >= -43200000000000 AND off < -3600000000000) >= 5 THEN median(dep) FILTER (off >= -43200000000000 AND off < -3600000000000) END AS base_depth,
arg_max(struct_pack(m := (bid_px_0 + ask_px_0) / 2.0), ts_event) FILTER (off < 0).m AS pre_mid FROM o GROUP BY ALL),
st AS (SELECT t.window_id, t.instrument, t.seq, t.ts_event, last_value(ask_px_0 - bid_px_0 IGNORE NULLS) OVER u AS spread, bid_sz_0 + ask_sz_0 AS depth, 100.0 * (bid_sz_0 + ask_sz_0) / nullif(base_depth, 0) AS depth_pct,
last_value((bid_px_0 + ask_px_0) / 2.0 - pre_mid IGNORE NULLS) OVER u AS mid_move, count(*) FILTER (action IN (3, 4)) OVER (PARTITION BY t.window_id, t.instrument ORDER BY ts_event RANGE BETWEEN 999999999 PRECEDING AND CURRENT ROW) AS trades_1s, count(*) OVER u AS updates
FROM ticks t LEFT JOIN ctx USING (window_id, instrument) WINDOW u AS (PARTITION BY t.window_id, t.instrument ORDER BY ts_event, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query()
def replay_state_snapshot(spark, folder):
    return _replay_states(spark, folder)[0]


SQL["replay_state_snapshot"] = with_steps("SELECT 1 AS one", ("ticks", "stages_t")).replace("final AS (SELECT 1 AS one)", _CTX.replace("arg_max(struct_pack(m := (bid_px_0 + ask_px_0) / 2.0), ts_event) FILTER (off < 0).m", "(arg_max(struct_pack(m := (bid_px_0 + ask_px_0) / 2.0), ts_event) FILTER (off < 0)).m") + ", final AS (SELECT * REPLACE (round(depth_pct, 6) AS depth_pct, round(mid_move, 6) + 0.0 AS mid_move) FROM st)")


@query()
def alerts_fired(spark, folder):
    s, keys = _replay_states(spark, folder)
    return replay.alerts(s, keys, 3, 25.0, 3600)


SQL["alerts_fired"] = SQL["replay_state_snapshot"].replace("SELECT * FROM final", """SELECT window_id, instrument, seq, alert FROM (SELECT *, unnest(['wide spread', 'thin depth', 'no data']) AS alert, unnest([spread > 3, depth_pct < 25, ts_event - lag(ts_event) OVER (PARTITION BY window_id, instrument ORDER BY ts_event, seq) > 3600000000000]) AS fires FROM st) WHERE fires""")


@query()
def trailing_trade_rate(spark, folder):
    t = quality.trailing_trades(tape.ticks(spark, folder), ["instrument"], 3600 * NS)
    return t.select("instrument", "seq", F.col("trades_1s").alias("trades_1h"))


SQL["trailing_trade_rate"] = with_steps("SELECT instrument, seq, count(*) FILTER (action IN (3, 4)) OVER (PARTITION BY instrument ORDER BY ts_event RANGE BETWEEN 3599999999999 PRECEDING AND CURRENT ROW) AS trades_1h FROM ticks", ("ticks",))


@query()
def tumbling_update_rate(spark, folder):
    d = replay.update_rates(tape.ticks(spark, folder), ["instrument"], "1 hour")
    return d.select("instrument", (F.unix_micros("window_start") * 1000).alias("start_ns"), "updates", "trades")


SQL["tumbling_update_rate"] = with_steps("SELECT instrument, ts_event // 3600000000000 * 3600000000000 AS start_ns, count(*) AS updates, count(*) FILTER (action IN (3, 4)) AS trades FROM ticks GROUP BY ALL", ("ticks",))


@query("""SELECT DISTINCT window_id, stage, CASE WHEN event_type = 'CONTROL' THEN 'CONTROL ' || time_et ELSE event_type || ' ' || replace(stage, '_', ' ') END AS "group" FROM stages""")
def group_labels(spark, folder):
    return table(spark, folder, "stages").select("window_id", "stage", group_label(F.col("event_type"), F.col("stage"), F.col("time_et")).alias("group")).distinct()


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
