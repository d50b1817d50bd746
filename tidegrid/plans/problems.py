"""Queries of the general data problems: implausible readings, regular grids, orphan references, unusable lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.shared import cut, shared_folder
from tidegrid.operators.counter_grid import counters_to_grids, last_readings, missing_points, read_grids
from tidegrid.operators.orphans import orphan_periods, parent_changes, references_of
from tidegrid.operators.spikes import Reading, implausible_readings
from tidegrid.sources.delimited import load_lines
from tidegrid.sources.tables import table
from tidegrid.streaming.orphans import IncrementalOrphans

NS = 1_000_000
SERIES = ["window_id", "stage", "instrument"]
READINGS = [Reading("crossed_book_rows"), Reading("bad_size_rows"), Reading("max_gap_s", "span", 5400.0)]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Impossible, stuck and spiking readings; dips, which are no cases here, are in p1_readings."""
    return p1_readings(spark, folder).filter("impossible or spike or stuck").select("quality_id", "field_name")


def p1_readings(spark: SparkSession, folder: str) -> DataFrame:
    """The implausible readings with what is wrong about each."""
    quality = table(spark, folder, "window_quality")
    return implausible_readings(quality, "quality_id", ["instrument", "feed_schema"], "checked_at", READINGS, total="n_rows")


def _stage_times(spark: SparkSession, folder: str) -> DataFrame:
    """t0_ns by (window_id, stage); deleted stages take part."""
    return table(spark, folder, "stages").dropna(subset=["window_id", "stage", "t0_ns"]).groupBy("window_id", "stage").agg(F.min("t0_ns").alias("t0_ns"))


def _updates(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    updates = table(spark, folder, "book_updates").select(*SERIES, "ts_event", *columns)
    return updates.join(_stage_times(spark, folder), ["window_id", "stage"]).withColumn("offset", F.col("ts_event") - F.col("t0_ns"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    grids = read_grids(table(spark, folder, "grids"), NS)
    panels = table(spark, folder, "panels").select(*SERIES, "grid_name", (F.col("offset_ms") * NS).alias("offset"))
    books = missing_points(_updates(spark, folder), SERIES, "offset", grids)
    points = books.unionByName(missing_points(panels.withColumnRenamed("grid_name", "g"), SERIES, "offset", grids, "g"))
    return points.select(*SERIES, "grid_name", F.expr(f"offset div {NS}").alias("offset_ms"))


def p2_book_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Both complete grids of every series of book_updates: the touch of the last update, or marked missing."""
    grids = read_grids(table(spark, folder, "grids"), NS)
    state = ["bid_px_0", "ask_px_0", "bid_sz_0", "ask_sz_0"]
    points = last_readings(_updates(spark, folder, "seq", *state), SERIES, "offset", ["seq"], state, grids)
    return points.select(*SERIES, "grid_name", F.expr(f"offset div {NS}").alias("offset_ms"), *state, "missing")


def p2_panel_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The complete grid of every series of panels: the last recorded point, or marked missing."""
    grids = read_grids(table(spark, folder, "grids"), NS)
    state = ["bid_px", "ask_px", "spread", "mid", "depth_1", "updates", "volume"]
    panels = table(spark, folder, "panels").select(*SERIES, F.col("grid_name").alias("g"), (F.col("offset_ms") * NS).alias("offset"), *state)
    # Rows of one offset differ only by their measures: the greatest of them counts.
    points = last_readings(panels, SERIES, "offset", state, state, grids, "g")
    return points.select(*SERIES, "grid_name", F.expr(f"offset div {NS}").alias("offset_ms"), *state, "missing")


def p2_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The feed's counter of updates (seq, cumulative in order of arrival) as arrivals per cell of both grids around each stage."""
    grids = read_grids(table(spark, folder, "grids"), 1000)
    updates = table(spark, folder, "book_updates").select("window_id", "stage", "seq", F.unix_micros(F.col("received_at").cast("timestamp")).alias("us"))
    updates = updates.join(_stage_times(spark, folder), ["window_id", "stage"]).withColumn("offset", F.col("us") - F.expr("t0_ns div 1000"))
    out = counters_to_grids(updates, ["window_id", "stage"], "offset", "seq", grids)
    return out.select("window_id", "stage", "grid_name", F.expr("offset div 1000").alias("offset_ms"), F.round("growth", 3).alias("growth"), "resets", F.round("covered", 6).alias("covered"))


_KEYS = ["field_name", "k0", "k1"]


def _orphan_events(spark: SparkSession, folder: str) -> DataFrame:
    """The history of both references of the entries, replayed year by year through the pending state."""
    entries, stages = table(spark, folder, "surprises"), table(spark, folder, "stages")
    refs = changes = None
    for name, own, parent in (("event_id", ["event_id"], ["event_id"]), ("release_date", ["event_type", "release_date"], ["event_type", "event_date"])):

        def keyed(df: DataFrame, many: bool = len(own) > 1, name: str = name) -> DataFrame:
            rest = [c for c in df.columns if c not in ("k0", "k1")]
            return df.select(F.lit(name).alias("field_name"), F.col("k0").cast("string").alias("k0"), (F.col("k1").cast("string") if many else F.lit("")).alias("k1"), *rest)

        r, c = keyed(references_of(entries, "entry_id", own, "entered_at")), keyed(parent_changes(stages, parent, "recorded_at", "deleted_at"))
        refs, changes = (r, c) if refs is None else (refs.unionByName(r), changes.unionByName(c))
    return IncrementalOrphans(spark, shared_folder(spark, "orphans"), _KEYS).replay(cut(refs), cut(changes), "year")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphan_events(spark, folder).filter("event = 'orphaned'").select(F.col("id").alias("entry_id"), "field_name")


def p3_events(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the unanswered references: orphaned, resolved, reopened, each with its moment."""
    return _orphan_events(spark, folder).select(F.col("id").alias("entry_id"), "field_name", F.timestamp_micros("t").alias("at"), "event")


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Unanswered references per field and month of entered_at, and how many a later record answered."""
    events = _orphan_events(spark, folder)
    first = events.filter("event = 'resolved'").groupBy("field_name", "id").agg(F.min("t").alias("resolved_us"))
    orphans = events.filter("event = 'orphaned'").select("field_name", "id", F.col("t").alias("entered_us"))
    return orphan_periods(orphans.join(first, ["field_name", "id"], "left"), "field_name", "entered_us")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return load_lines(table(spark, folder, "surprise_lines"), "line", keep=("line_id", "file_name", "line_no"), header="line_no")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).filter("reason is not null").select("line_id").distinct()


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The sound lines as typed surprises."""
    return _lines(spark, folder).filter("reason is null").drop("reason", "file_name", "line_no")


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The unusable lines with the reason of each."""
    return _lines(spark, folder).filter("reason is not null").select("line_id", "file_name", "line_no", "reason")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p1_found, p1_readings, p2_found, p2_book_grid, p2_panel_grid, p2_arrivals, p3_found, p3_events, p3_periods, p5_found, p5_loaded, p5_reasons)
    }


_FIELD = '("([^"]|"")*"|[^",]*)'
_LINE = "^" + ",".join([_FIELD] * 10) + "$"
_UNQUOTE = "CASE WHEN {0} LIKE '\"%' THEN replace(substr({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"
_NUMBER = r"^[ \t]*[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?[ \t]*$"
_WEB = r"^https?://[^\s\pZ/?#:@]+(:[0-9]+)?([/?#][^\s\pZ]*)?$"


def _field(i: int) -> str:
    skip = ",".join(['(?:"(?:[^"]|"")*"|[^",]*)'] * i)
    raw = f"regexp_extract(line, '^{skip}{',' if i else ''}((?:\"(?:[^\"]|\"\")*\"|[^\",]*))', 1)"
    return _UNQUOTE.format(raw)


_JUDGED = f"""
lines AS (SELECT * FROM surprise_lines WHERE line_no IS NULL OR line_no <> 1),
judged AS (SELECT *, coalesce(regexp_matches(line, '{_LINE}') AND regexp_matches({_field(4)}, '{_NUMBER}')
    AND regexp_matches({_field(5)}, '{_NUMBER}') AND regexp_matches({_field(8)}, '{_WEB}'), false) AS sound FROM lines)"""
_GRID_POINTS = """
points AS (SELECT grid_name, max_age_ms, start_ms + step_ms * i AS offset_ms
    FROM grids, generate_series(0, 100000) AS s(i) WHERE start_ms + step_ms * i <= end_ms),
starts AS (SELECT window_id, stage, min(t0_ns) AS t0_ns FROM stages GROUP BY ALL),
updates AS (SELECT window_id, stage, instrument, ts_event - t0_ns AS o, b.* FROM book_updates b JOIN starts USING (window_id, stage))"""


_PANEL = ["bid_px", "ask_px", "spread", "mid", "depth_1", "updates", "volume"]
#: Of the rows of one offset the greatest counts, measure by measure, a missing measure being the least.
_NULLS_FIRST = ", ".join(f"({c} IS NOT NULL)::INT AS has_{c}, coalesce(CAST({c} AS DOUBLE), 0) AS val_{c}" for c in _PANEL)
_STATE = ", ".join(f"h_{c} := has_{c}, v_{c} := val_{c}, {c} := {c}" for c in _PANEL)


def _number(i: int) -> str:
    f = _field(i)
    return f"CASE WHEN regexp_matches({f}, '{_NUMBER}') THEN CAST(replace(trim({f}), ',', '') AS DOUBLE) END"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""WITH {_GRID_POINTS},
series AS (SELECT DISTINCT window_id, stage, instrument FROM updates),
spine AS (SELECT * FROM series, points),
readings AS (SELECT DISTINCT window_id, stage, instrument, o FROM updates),
booked AS (SELECT s.*, r.o FROM spine s ASOF LEFT JOIN readings r ON s.window_id = r.window_id AND s.stage = r.stage
    AND s.instrument = r.instrument AND s.offset_ms * 1000000 >= r.o),
panel_readings AS (SELECT DISTINCT window_id, stage, instrument, grid_name, offset_ms AS o FROM panels),
panel_spine AS (SELECT s.*, p.offset_ms, p.max_age_ms FROM (SELECT DISTINCT window_id, stage, instrument, grid_name FROM panels) s JOIN points p USING (grid_name)),
paneled AS (SELECT s.*, r.o FROM panel_spine s ASOF LEFT JOIN panel_readings r ON s.window_id = r.window_id AND s.stage = r.stage
    AND s.instrument = r.instrument AND s.grid_name = r.grid_name AND s.offset_ms >= r.o)
SELECT window_id, stage, instrument, grid_name, offset_ms FROM booked WHERE o IS NULL OR o <= (offset_ms - max_age_ms) * 1000000
UNION ALL
SELECT window_id, stage, instrument, grid_name, offset_ms FROM paneled WHERE o IS NULL OR o <= offset_ms - max_age_ms""",
        "p2_book_grid": f"""WITH {_GRID_POINTS},
series AS (SELECT DISTINCT window_id, stage, instrument FROM updates),
spine AS (SELECT * FROM series, points),
readings AS (SELECT window_id, stage, instrument, o, arg_max(struct_pack(b := bid_px_0, a := ask_px_0, p := bid_sz_0, q := ask_sz_0), seq) AS s FROM updates GROUP BY ALL),
booked AS (SELECT s.*, r.o, r.s FROM spine s ASOF LEFT JOIN readings r ON s.window_id = r.window_id AND s.stage = r.stage
    AND s.instrument = r.instrument AND s.offset_ms * 1000000 >= r.o),
judged AS (SELECT *, o IS NULL OR o <= (offset_ms - max_age_ms) * 1000000 AS missing FROM booked)
SELECT window_id, stage, instrument, grid_name, offset_ms, CASE WHEN NOT missing THEN s.b END AS bid_px_0, CASE WHEN NOT missing THEN s.a END AS ask_px_0,
    CASE WHEN NOT missing THEN s.p END AS bid_sz_0, CASE WHEN NOT missing THEN s.q END AS ask_sz_0, missing FROM judged""",
        "p2_panel_grid": f"""WITH {_GRID_POINTS},
readings AS (SELECT window_id, stage, instrument, grid_name, offset_ms AS o, max(struct_pack({_STATE})) AS s FROM (SELECT *, {_NULLS_FIRST} FROM panels) GROUP BY ALL),
spine AS (SELECT s.*, p.offset_ms, p.max_age_ms FROM (SELECT DISTINCT window_id, stage, instrument, grid_name FROM panels) s JOIN points p USING (grid_name)),
held AS (SELECT s.*, r.o, r.s FROM spine s ASOF LEFT JOIN readings r ON s.window_id = r.window_id AND s.stage = r.stage AND s.instrument = r.instrument AND s.grid_name = r.grid_name AND s.offset_ms >= r.o),
judged AS (SELECT *, o IS NULL OR o <= offset_ms - max_age_ms AS missing FROM held)
SELECT window_id, stage, instrument, grid_name, offset_ms, {', '.join(f'CASE WHEN NOT missing THEN s.{c} END AS {c}' for c in _PANEL)}, missing FROM judged""",
        "p2_arrivals": f"""WITH {_GRID_POINTS},
r AS (SELECT window_id, stage, epoch_us(received_at) - t0_ns // 1000 AS t, max(seq) AS v FROM book_updates JOIN starts USING (window_id, stage) WHERE received_at IS NOT NULL AND seq IS NOT NULL GROUP BY ALL),
d AS (SELECT *, lag(t) OVER w AS f, lag(v) OVER w AS p FROM r WINDOW w AS (PARTITION BY window_id, stage ORDER BY t)),
i AS (SELECT window_id, stage, t, f, CASE WHEN v < p THEN v ELSE v - p END AS grow, v < p AS reset FROM d WHERE f IS NOT NULL),
c AS (SELECT i.*, g.grid_name, g.step_ms * 1000 AS step, g.max_age_ms * 1000 AS reach, g.offset_ms, g.offset_ms * 1000 AS z, least(t, g.offset_ms * 1000) - greatest(f, (g.offset_ms - g.step_ms) * 1000) AS overlap
    FROM i JOIN (SELECT p.*, step_ms FROM points p JOIN (SELECT grid_name, step_ms FROM grids) USING (grid_name)) g ON i.t > (g.offset_ms - g.step_ms) * 1000 AND i.f < g.offset_ms * 1000)
SELECT window_id, stage, grid_name, offset_ms, CASE WHEN sum(CASE WHEN t - f < reach THEN overlap ELSE 0 END) > 0 THEN round(sum(grow * overlap / CAST(t - f AS DOUBLE)), 3) END AS growth, count(*) FILTER (reset AND t > z - step AND t <= z) AS resets,
    round(sum(CASE WHEN t - f < reach THEN overlap ELSE 0 END) / CAST(any_value(step) AS DOUBLE), 6) AS covered FROM c WHERE overlap > 0 GROUP BY window_id, stage, grid_name, offset_ms""",
        "p3_found": """WITH entries AS (SELECT DISTINCT entry_id, event_id, event_type, release_date, entered_at FROM surprises)
SELECT entry_id, 'event_id' AS field_name FROM entries e WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stages s
    WHERE s.event_id = e.event_id AND s.recorded_at <= e.entered_at AND (s.deleted_at IS NULL OR s.deleted_at > e.entered_at))
UNION ALL
SELECT entry_id, 'release_date' AS field_name FROM entries e WHERE release_date IS NOT NULL AND event_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stages s
    WHERE s.event_type = e.event_type AND s.event_date = e.release_date AND s.recorded_at <= e.entered_at AND (s.deleted_at IS NULL OR s.deleted_at > e.entered_at))""",
        "p3_periods": """WITH entries AS (SELECT DISTINCT entry_id, event_id, event_type, release_date, entered_at FROM surprises),
orphans AS (
SELECT 'event_id' AS field_name, entered_at, EXISTS (SELECT 1 FROM stages s WHERE s.event_id = e.event_id AND s.recorded_at > e.entered_at
    AND (s.deleted_at IS NULL OR s.deleted_at > s.recorded_at)) AS later
FROM entries e WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stages s
    WHERE s.event_id = e.event_id AND s.recorded_at <= e.entered_at AND (s.deleted_at IS NULL OR s.deleted_at > e.entered_at))
UNION ALL
SELECT 'release_date' AS field_name, entered_at, EXISTS (SELECT 1 FROM stages s WHERE s.event_type = e.event_type AND s.event_date = e.release_date
    AND s.recorded_at > e.entered_at AND (s.deleted_at IS NULL OR s.deleted_at > s.recorded_at)) AS later
FROM entries e WHERE release_date IS NOT NULL AND event_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stages s
    WHERE s.event_type = e.event_type AND s.event_date = e.release_date AND s.recorded_at <= e.entered_at AND (s.deleted_at IS NULL OR s.deleted_at > e.entered_at)))
SELECT field_name, CAST(date_trunc('month', entered_at) AS DATE) AS period, count(*) AS orphans, count(*) FILTER (later) AS resolved_later FROM orphans GROUP BY ALL""",
        "p5_reasons": f"""WITH lines AS (SELECT *, regexp_replace(line, '"[^"]*("|$)', '', 'g') AS bare FROM surprise_lines WHERE line_no IS NULL OR line_no <> 1),
judged AS (SELECT line_id, file_name, line_no, CASE WHEN line IS NULL THEN 'no line' WHEN trim(line, E' \t\r\n\f\x0b') = '' THEN 'empty line' WHEN NOT regexp_matches(line, '^{_FIELD}(,{_FIELD})*$') THEN 'broken quoting'
    WHEN length(bare) - length(replace(bare, ',', '')) <> 9 THEN 'column count' WHEN NOT regexp_matches({_field(4)}, '{_NUMBER}') THEN 'invalid actual' WHEN NOT regexp_matches({_field(5)}, '{_NUMBER}') THEN 'invalid consensus'
    WHEN NOT regexp_matches({_field(8)}, '{_WEB}') THEN 'invalid source_url' END AS reason FROM lines) SELECT * FROM judged WHERE reason IS NOT NULL""",
        "p5_found": f"WITH {_JUDGED} SELECT DISTINCT line_id FROM judged WHERE NOT sound",
        "p5_loaded": f"""WITH {_JUDGED} SELECT line_id, {_field(0)} AS event_id, {_field(1)} AS event_type,
    CASE WHEN regexp_matches({_field(2)}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({_field(2)} AS DATE) END AS release_date, {_field(3)} AS variable,
    {_number(4)} AS actual, {_number(5)} AS consensus, {_number(6)} AS prior, {_field(7)} AS unit, {_field(8)} AS source_url, {_field(9)} AS notes FROM judged WHERE sound""",
    }
