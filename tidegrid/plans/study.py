"""Queries of the event study on the demonstration tape, and their SQL.

The SQL is written as a chain of named steps; a query takes the steps it needs and a final SELECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import TAPE
from tidegrid.functions.shared import cut, shared_folder
from tidegrid.operators import execution, liquidity, panel, reaction, regression, stats, strategy
from tidegrid.sources import tape
from tidegrid.store import build_panels, read_part, session_table

COARSE, FINE = TAPE.coarse.grid("coarse"), TAPE.fine.grid("fine")
SQL: dict[str, str] = {}
QUERIES: dict = {}
#: Value of a tick by instrument of the tape.
TICK_USD = {"click": 15.625, "view": 12.5, "purchase": 10.0, "signup": 31.25, "error": 7.8125}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating columns to six places, -0.0 as 0.0, so that engines agree on the last bits."""
    return df.select(*[(F.round(F.col(n), places) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def query(sql: str | None = None, steps: tuple[str, ...] = ()):
    """Register a query; `sql` is the final SELECT over the steps."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder))
        if sql:
            SQL[f.__name__] = with_steps(sql, steps)
        return f

    return add


def _grid_sql(name: str, g) -> str:
    return f"""{name}_points AS (SELECT CAST(j AS BIGINT) AS j, {g.start} + j * {g.step} AS p FROM generate_series(0, {g.points - 1}) AS s(j))"""


def _panel_sql(name: str, g) -> str:
    depths = ", ".join(f"{'+'.join(f't.bid_sz_{i} + t.ask_sz_{i}' for i in range(k))} AS depth_{k}" for k in (1, 3, 5, 10))
    return f"""{name}_cells AS (SELECT window_id, event_type, stage, time_et, instrument, CAST(greatest(0, ceil((off - {g.start}) / CAST({g.step} AS DOUBLE))) AS BIGINT) AS j, count(*) AS updates,
    count(*) FILTER (action IN (3, 4)) AS trades, CAST(coalesce(sum(size) FILTER (action IN (3, 4)), 0) AS BIGINT) AS volume,
    CAST(coalesce(sum(CASE WHEN side = 1 THEN size ELSE -size END) FILTER (action IN (3, 4)), 0) AS BIGINT) AS signed_volume FROM staged WHERE off <= {g.end} GROUP BY ALL),
{name}_series AS (SELECT DISTINCT window_id, event_type, stage, time_et, instrument FROM staged),
{name}_spine AS (SELECT * FROM {name}_series, {name}_points),
{name} AS (SELECT s.window_id, s.event_type, s.stage, s.time_et, s.instrument, CAST(s.p // 1000000 AS BIGINT) AS offset_ms,
    CASE WHEN t.ask_px_0 IS NOT NULL THEN t.bid_px_0 END AS bid_px, t.ask_px_0 AS ask_px, t.bid_sz_0 AS bid_sz, t.ask_sz_0 AS ask_sz,
    t.ask_px_0 - t.bid_px_0 AS spread, (t.bid_px_0 + t.ask_px_0) / 2.0 AS mid, (t.bid_px_0 + t.ask_px_0) / 2.0 - r.pre_mid AS mid_move, {depths},
    CASE WHEN s.j > 0 THEN coalesce(c.updates, 0) END AS updates, CASE WHEN s.j > 0 THEN coalesce(c.trades, 0) END AS trades,
    CASE WHEN s.j > 0 THEN coalesce(c.volume, 0) END AS volume, CASE WHEN s.j > 0 THEN coalesce(c.signed_volume, 0) END AS signed_volume
    FROM {name}_spine s ASOF LEFT JOIN staged t ON s.window_id = t.window_id AND s.stage = t.stage AND s.instrument = t.instrument AND s.p >= t.off
    LEFT JOIN {name}_cells c ON s.window_id = c.window_id AND s.stage = c.stage AND s.instrument = c.instrument AND s.j = c.j
    LEFT JOIN pre r ON s.window_id = r.window_id AND s.stage = r.stage AND s.instrument = r.instrument)"""


_levels = ", ".join(
    f"p - h - {i} AS bid_px_{i}, CASE WHEN kk % 17 <> 0 THEN p + h + {i} END AS ask_px_{i}, 1 + (kk * {i + 1}) % 40 AS bid_sz_{i}, 1 + (kk * {i + 3}) % 40 AS ask_sz_{i}" for i in range(10)
)
_week = ", ".join(f"({d}, '{t}', '{s}', '{e}', {int(e[:2]) * 60 + int(e[3:])})" for d, rows in tape.WEEK.items() for t, s, e in rows)
#: Eastern time is UTC-4 from the second Sunday of March to the first of November (fixed rule), else UTC-5.
ET_HOURS = """CASE WHEN {d} >= make_date(year({d}), 3, 14 - (isodow(make_date(year({d}), 3, 14)) % 7)) AND {d} < make_date(year({d}), 11, 7 - (isodow(make_date(year({d}), 11, 7)) % 7)) THEN 4 ELSE 5 END"""
STEPS = {
    "raw": "raw AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS kk, 10000 + CAST(round_even(value * 100, 0) AS BIGINT) AS p FROM events)",
    "ticks": f"""ticks AS (SELECT 'D' || strftime(ts, '%Y-%m-%d') AS window_id, event_type AS instrument, event_id AS seq, epoch_us(ts) * 1000 AS ts_event,
    CASE WHEN kk % 4 = 0 THEN 3 ELSE 2 END AS action, kk % 3 - 1 AS side, p AS price, 1 + kk % 7 AS size, {_levels} FROM (SELECT *, 1 + kk % 3 AS h FROM raw))""",
    "stages_t": f"""stages_t AS (SELECT 'D' || strftime(day, '%Y-%m-%d') AS window_id, w.event_type, w.stage, w.time_et, day,
    (epoch_us(day) // 60000000 + w.minutes + 60 * {ET_HOURS.format(d="day")}) * 60000000000 AS t0_ns
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d JOIN (VALUES {_week}) w(dow, event_type, stage, time_et, minutes) ON isodow(day) = w.dow)""",
    "staged": "staged AS (SELECT t.*, s.event_type, s.stage, s.time_et, t.ts_event - s.t0_ns AS off FROM ticks t JOIN stages_t s USING (window_id))",
    "pre": "pre AS (SELECT window_id, stage, instrument, arg_max(struct_pack(m := (bid_px_0 + ask_px_0) / 2.0), ts_event).m AS pre_mid FROM staged WHERE off < 0 GROUP BY ALL)",
    "coarse_points": _grid_sql("coarse", COARSE), "coarse": _panel_sql("coarse", COARSE), "fine_points": _grid_sql("fine", FINE), "fine": _panel_sql("fine", FINE),
    "base": f"""base AS (SELECT window_id, event_type, stage, instrument, {', '.join(f'median({m}) AS base_{m}' for m in panel.BASELINE_MEASURES)}
    FROM coarse WHERE offset_ms >= {TAPE.baseline_s[0] * 1000} AND offset_ms < {TAPE.baseline_s[1] * 1000} GROUP BY ALL)""",
    "liq": """liq AS (SELECT c.*, b.base_depth_1, b.base_spread, 100.0 * c.depth_1 / nullif(b.base_depth_1, 0) AS depth_pct,
    CASE WHEN c.event_type = 'CONTROL' THEN 'CONTROL ' || c.time_et ELSE c.event_type || ' ' || replace(c.stage, '_', ' ') END AS "group"
    FROM coarse c LEFT JOIN base b USING (window_id, event_type, stage, instrument))""",
    "points": f"""points AS (SELECT window_id, stage, "group", instrument, CAST(offset_ms // 1000 AS BIGINT) AS offset_s, unnest(['depth_pct', 'wide_spread', 'updates_per_s', 'trades_per_s']) AS measure,
    unnest([depth_pct, CASE WHEN coalesce(spread > 1, false) THEN 1.0 ELSE 0.0 END, CAST(updates AS DOUBLE), CAST(trades AS DOUBLE)]) AS value
    FROM liq WHERE offset_ms BETWEEN {TAPE.curve_s[0] * 1000} AND {TAPE.curve_s[1] * 1000})""",
    "smooth": """smooth AS (SELECT *, list_median([depth_pct, CASE WHEN rn > 1 THEN p1 ELSE f END, CASE WHEN rn > 2 THEN p2 ELSE f END,
    CASE WHEN rn <= n - 1 THEN n1 ELSE l END, CASE WHEN rn <= n - 2 THEN n2 ELSE l END]) AS smooth FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER a AS n, lag(depth_pct, 1) OVER w AS p1,
    lag(depth_pct, 2) OVER w AS p2, lead(depth_pct, 1) OVER w AS n1, lead(depth_pct, 2) OVER w AS n2, first_value(depth_pct) OVER a AS f, last_value(depth_pct) OVER a AS l FROM liq
    WINDOW w AS (PARTITION BY window_id, stage, instrument ORDER BY offset_ms),
    a AS (PARTITION BY window_id, stage, instrument ORDER BY offset_ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))""",
    "metrics": f"""metrics AS (SELECT window_id, stage, "group", instrument, min(smooth) FILTER (s BETWEEN {TAPE.around_s[0]} AND {TAPE.around_s[1]}) AS min_depth_pct,
    CAST(max(spread) FILTER (s BETWEEN {TAPE.first_minute_s[0]} AND {TAPE.first_minute_s[1]}) AS DOUBLE) AS max_spread_first_min,
    min(s) FILTER (h50 = {TAPE.hold} AND s >= 0) AS recovery_50_s, min(s) FILTER (h90 = {TAPE.hold} AND s >= 0) AS recovery_90_s, min(s) FILTER (hs = {TAPE.hold} AND s >= 0) AS spread_recovery_s
    FROM (SELECT *, offset_ms / 1000.0 AS s, sum(CASE WHEN smooth >= 50 THEN 1 ELSE 0 END) OVER h AS h50, sum(CASE WHEN smooth >= 90 THEN 1 ELSE 0 END) OVER h AS h90,
    sum(CASE WHEN spread <= base_spread + 1e-9 THEN 1 ELSE 0 END) OVER h AS hs FROM smooth
    WINDOW h AS (PARTITION BY window_id, stage, instrument ORDER BY offset_ms ROWS BETWEEN CURRENT ROW AND {TAPE.hold - 1} FOLLOWING)) GROUP BY ALL)""",
    "fine_moves": "fine_moves AS (SELECT *, mid - lag(mid) OVER (PARTITION BY window_id, stage, instrument ORDER BY offset_ms) AS d FROM fine)",
    "k": f"""k AS (SELECT instrument, greatest(v, 0.5) AS k_ticks, n AS control_steps FROM (SELECT instrument, abs(d) AS v, row_number() OVER (PARTITION BY instrument ORDER BY abs(d)) AS rn,
    count(*) OVER (PARTITION BY instrument) AS n FROM fine_moves WHERE event_type = 'CONTROL' AND d IS NOT NULL) WHERE rn = CAST(round_even({TAPE.first_move_quantile} * (n - 1), 0) AS BIGINT) + 1)""",
    "moves": f"""moves AS (SELECT window_id, event_type, stage, time_et, instrument, off AS offset_ns, mid - pre_mid AS mid_move FROM (SELECT s.*, (bid_px_0 + ask_px_0) / 2.0 AS mid,
    lag((bid_px_0 + ask_px_0) / 2.0) OVER (PARTITION BY window_id, stage, instrument ORDER BY ts_event, seq) AS b
    FROM staged s WHERE off BETWEEN {TAPE.moves_s[0]}000000000 AND {TAPE.moves_s[1]}000000000) LEFT JOIN pre USING (window_id, stage, instrument) WHERE mid IS NOT NULL AND mid IS DISTINCT FROM b)""",
    "first": """first AS (SELECT window_id, event_type, stage, instrument, min(offset_ns) FILTER (abs(mid_move) > k_ticks) / 1e6 AS first_move_ms,
    arg_min(mid_move, offset_ns) FILTER (abs(mid_move) > k_ticks) AS first_move_ticks FROM moves JOIN k USING (instrument) WHERE event_type <> 'CONTROL' AND offset_ns >= 0 GROUP BY ALL)""",
    "jumps": f"""jumps AS (SELECT c.window_id, c.event_type, c.stage, c.instrument, CAST(offset_ms // 1000 AS BIGINT) AS horizon_s, mid_move, abs(mid_move) AS abs_move_ticks, vol_1s,
    abs(mid_move) / nullif(vol_1s * sqrt(offset_ms / {TAPE.coarse.step_ms}.0), 0) AS abs_move_vol
    FROM coarse c LEFT JOIN (SELECT window_id, stage, instrument, stddev_samp(d) AS vol_1s FROM (SELECT *, mid - lag(mid) OVER (PARTITION BY window_id, stage, instrument ORDER BY offset_ms) AS d FROM coarse
    WHERE offset_ms BETWEEN {TAPE.baseline_s[0] * 1000} AND {TAPE.baseline_s[1] * 1000 - TAPE.coarse.step_ms}) GROUP BY ALL) v USING (window_id, stage, instrument)
    WHERE offset_ms IN ({', '.join(str(h * 1000) for h in TAPE.horizons_s)}))""",
    "lagged": f"""lagged AS (SELECT y.window_id, y.event_type, y.stage, y.instrument, CAST(l.lag * {TAPE.fine.step_ms} AS INTEGER) AS lag_ms,
    CASE WHEN count(*) >= 5 AND max(x.d) > min(x.d) AND max(y.d) > min(y.d) THEN corr(x.d, y.d) END AS corr
    FROM fine_moves x, generate_series(-{TAPE.lag_steps}, {TAPE.lag_steps}) AS l(lag), fine_moves y WHERE x.instrument = '{TAPE.reference}' AND y.instrument <> '{TAPE.reference}'
    AND x.window_id = y.window_id AND x.stage = y.stage AND y.offset_ms = x.offset_ms + l.lag * {TAPE.fine.step_ms} AND x.event_type <> 'CONTROL' AND x.d IS NOT NULL AND y.d IS NOT NULL
    AND x.offset_ms BETWEEN 0 AND {TAPE.lag_window_s * 1000} AND y.offset_ms BETWEEN 0 AND {TAPE.lag_window_s * 1000} GROUP BY ALL)""",
    "turnover": "turnover AS (SELECT CAST(ts AS DATE) AS day, sum(p) AS t FROM raw GROUP BY ALL)",
    "surprises_t": """surprises_t AS (SELECT s.window_id AS event_id, s.event_type, s.day AS release_date, CAST(a.t - b.t AS BIGINT) AS surprise
    FROM stages_t s JOIN turnover a ON a.day = s.day - 1 JOIN turnover b ON b.day = s.day - 2 WHERE s.event_type IN ('CPI', 'NFP'))""",
    "implied": f"""implied AS (SELECT window_id AS event_id, event_type, CASE WHEN sd > 0 THEN -move_ticks / sd END AS z, move_ticks FROM (SELECT *, stddev_samp(move_ticks) OVER () AS sd FROM (SELECT window_id, event_type,
    max(mid) FILTER (offset_ms = {TAPE.surprise_window_s[1] * 1000}) - max(mid) FILTER (offset_ms = {TAPE.surprise_window_s[0] * 1000}) AS move_ticks FROM coarse
    WHERE event_type = 'FOMC' AND stage = 'statement' AND instrument = '{TAPE.surprise_instrument}' AND offset_ms IN ({TAPE.surprise_window_s[0] * 1000}, {TAPE.surprise_window_s[1] * 1000}) GROUP BY ALL)))""",
    "zs": """zs AS (SELECT event_id, event_type, z FROM implied WHERE z IS NOT NULL UNION ALL
    SELECT event_id, event_type, surprise / sd AS z FROM (SELECT *, stddev_samp(surprise) OVER (PARTITION BY event_type) AS sd FROM surprises_t) WHERE sd > 1e-9)""",
    "returns": f"""returns AS (SELECT c.window_id, c.event_type, c.stage, c.instrument, CAST(c.offset_ms // 1000 AS BIGINT) AS horizon_s, c.mid_move AS ret_ticks, 1e4 * c.mid_move / nullif(p.mid, 0) AS ret_bps
    FROM coarse c LEFT JOIN (SELECT window_id, stage, instrument, mid FROM coarse WHERE offset_ms = {TAPE.pre_s * 1000}) p USING (window_id, stage, instrument)
    WHERE c.event_type <> 'CONTROL' AND c.offset_ms IN ({', '.join(str(h * 1000) for h in TAPE.horizons_s)}))""",
    "tests": """tests AS (SELECT window_id, event_type, stage, instrument, horizon_s, unit, z, ret, greatest(z, 0.0) AS z_pos, least(z, 0.0) AS z_neg FROM (SELECT r.*, z.z, unnest(['ret_ticks', 'ret_bps']) AS unit, unnest([ret_ticks, ret_bps]) AS ret
    FROM returns r JOIN zs z ON z.event_id = r.window_id WHERE r.stage = CASE r.event_type WHEN 'FOMC' THEN 'statement' ELSE 'release' END))""",
    "walk": f"""walk_book AS (SELECT s.window_id, s.stage, s.event_type, s.time_et, s.instrument, CAST(s.p // 1000000000 AS BIGINT) AS offset_s, CAST(q.qty AS INTEGER) AS qty, t.bid_px_0, t.ask_px_0,
    [t.ask_px_0, {', '.join(f't.ask_px_{i}' for i in range(1, 10))}] AS ap, [{', '.join(f't.ask_sz_{i}' for i in range(10))}] AS asz, [{', '.join(f't.bid_px_{i}' for i in range(10))}] AS bp, [{', '.join(f't.bid_sz_{i}' for i in range(10))}] AS bsz
    FROM coarse_spine s ASOF LEFT JOIN staged t ON s.window_id = t.window_id AND s.stage = t.stage AND s.instrument = t.instrument AND s.p >= t.off, (VALUES {', '.join(f'({q})' for q in TAPE.order_sizes)}) q(qty)),
walk_levels AS (SELECT * EXCLUDE (ap, asz, bp, bsz), unnest(range(0, 10)) AS i, unnest(ap) AS a, unnest(asz) AS az, unnest(bp) AS b, unnest(bsz) AS bz FROM walk_book),
walk_take AS (SELECT *, greatest(0, least(qty - coalesce(sum(CASE WHEN a IS NOT NULL THEN az ELSE 0 END) OVER w, 0), coalesce(CASE WHEN a IS NOT NULL THEN az END, 0))) AS ta,
    greatest(0, least(qty - coalesce(sum(CASE WHEN b IS NOT NULL THEN bz ELSE 0 END) OVER w, 0), coalesce(CASE WHEN b IS NOT NULL THEN bz END, 0))) AS tb FROM walk_levels
    WINDOW w AS (PARTITION BY window_id, stage, instrument, offset_s, qty ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
walk AS (SELECT window_id, CASE WHEN event_type = 'CONTROL' THEN 'CONTROL ' || time_et ELSE event_type || ' ' || replace(stage, '_', ' ') END AS "group", instrument, offset_s, qty,
    CASE WHEN sum(ta) >= qty THEN sum(ta * a) / CAST(qty AS DOUBLE) END - (max(bid_px_0) + max(ask_px_0)) / 2.0 AS buy_ticks,
    (max(bid_px_0) + max(ask_px_0)) / 2.0 - CASE WHEN sum(tb) >= qty THEN sum(tb * b) / CAST(qty AS DOUBLE) END AS sell_ticks, sum(ta) < qty OR sum(tb) < qty AS insufficient_depth
    FROM walk_take GROUP BY window_id, stage, event_type, time_et, instrument, offset_s, qty)""",
    "cost_curve": """cost_curve AS (SELECT "group", instrument, qty, offset_s, avg((buy_ticks + sell_ticks) / 2) AS mean_ticks, avg(CASE WHEN insufficient_depth THEN 1.0 ELSE 0.0 END) AS share_insufficient,
    any_value(n) AS n_events FROM walk JOIN (SELECT "group", instrument, qty, count(DISTINCT window_id) AS n FROM walk GROUP BY ALL) USING ("group", instrument, qty) GROUP BY "group", instrument, qty, offset_s)""",
    "rule_rows": f"""rule_rows AS (SELECT *, (xb + xa) / 2.0 - (eb + ea) / 2.0 AS ret, row_number() OVER (PARTITION BY event_type, instrument, delay_s, exit_s ORDER BY release_date, event_id) - 1 AS k,
    count(*) OVER (PARTITION BY event_type, instrument, delay_s, exit_s) AS n FROM (SELECT a.window_id AS event_id, a.event_type, a.instrument, p.delay_s, p.exit_s, a.bid_px AS eb, a.ask_px AS ea, z.bid_px AS xb, z.ask_px AS xa, s.release_date, s.surprise
    FROM (VALUES {', '.join(f'({d}, {x})' for d in TAPE.delays_s for x in TAPE.exits_s if x > d)}) p(delay_s, exit_s) JOIN coarse a ON a.offset_ms = p.delay_s * 1000
    JOIN coarse z ON z.offset_ms = p.exit_s * 1000 AND z.window_id = a.window_id AND z.instrument = a.instrument AND z.stage = a.stage JOIN surprises_t s ON s.event_id = a.window_id AND s.event_type = a.event_type)
    QUALIFY n >= {TAPE.least_training + 1})""",
    "scaled": """scaled AS (SELECT *, CASE WHEN k >= 2 AND sd0 > 1e-9 THEN sd0 END AS sd, surprise / CASE WHEN k >= 2 AND sd0 > 1e-9 THEN sd0 END AS z FROM (SELECT *, stddev_samp(surprise) OVER (PARTITION BY event_type, instrument, delay_s, exit_s
    ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd0 FROM rule_rows))""",
    "learned": f"""learned AS (SELECT *, greatest(coalesce(g0, -1e308), coalesce(g1, -1e308), coalesce(g2, -1e308)) AS g FROM (SELECT l.event_type, l.instrument, l.delay_s, l.exit_s, l.k, sign(regr_slope(p.ret, p.surprise / l.sd)) AS sg,
    {', '.join(f"sign(regr_slope(p.ret, p.surprise / l.sd)) * avg(sign(p.surprise) * p.ret) FILTER (abs(p.surprise / l.sd) > {t} AND p.surprise <> 0) AS g{i}" for i, t in enumerate(TAPE.thresholds))}
    FROM scaled l JOIN scaled p ON p.event_type = l.event_type AND p.instrument = l.instrument AND p.delay_s = l.delay_s AND p.exit_s = l.exit_s AND p.k < l.k AND p.ret IS NOT NULL
    WHERE l.k >= {TAPE.least_training} AND l.z IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND max(p.surprise) > min(p.surprise)) WHERE sg <> 0)""",
    "decided": """decided AS (SELECT s.*, coalesce(l.sg, 0.0) AS sign_mapping, l.threshold, CASE WHEN coalesce(abs(s.z) > l.threshold, false) THEN l.sg * sign(s.z) ELSE 0.0 END AS direction
    FROM scaled s LEFT JOIN (SELECT event_type, instrument, delay_s, exit_s, k, sg, CASE WHEN g0 >= g - 1e-12 THEN 0.0 WHEN g1 >= g - 1e-12 THEN 0.5 ELSE 1.0 END AS threshold FROM learned WHERE g > -1e308) l USING (event_type, instrument, delay_s, exit_s, k))""",
    "backtested": f"""backtested AS (SELECT event_type, instrument, delay_s, exit_s, event_id, release_date, k < {TAPE.least_training} AS training_only, z, threshold, sign_mapping, direction,
    CASE WHEN direction <> 0 THEN gross END AS gross_ticks, CASE WHEN direction <> 0 THEN gross - fee END AS net_ticks, CASE WHEN direction <> 0 THEN (gross - fee) * tick_usd END AS net_usd,
    CASE WHEN k >= {TAPE.least_training} AND ret <> 0 THEN CASE WHEN ret > 0 THEN xb - ea ELSE eb - xa END - fee END AS upper_bound_net_ticks,
    CASE WHEN k >= {TAPE.least_training} THEN ((xb - ea) + (eb - xa)) / 2.0 - fee END AS random_net_ticks
    FROM (SELECT *, {2 * TAPE.fee_usd!r} / tick_usd AS fee, CAST(CASE WHEN direction > 0 THEN xb - ea WHEN direction < 0 THEN eb - xa ELSE 0 END AS DOUBLE) AS gross FROM decided JOIN (VALUES {', '.join(f"('{i}', CAST({u} AS DOUBLE))" for i, u in TICK_USD.items())}) v(instrument, tick_usd) USING (instrument)))""",
}
ORDER = list(STEPS)
NEEDS = {
    "ticks": ["raw"], "staged": ["ticks", "stages_t"], "pre": ["staged"], "coarse": ["coarse_points", "staged", "pre"], "fine": ["fine_points", "staged", "pre"], "base": ["coarse"], "liq": ["base"], "points": ["liq"],
    "smooth": ["liq"], "metrics": ["smooth"], "fine_moves": ["fine"], "k": ["fine_moves"], "moves": ["pre"], "first": ["moves", "k"], "jumps": ["coarse"], "lagged": ["fine_moves"], "turnover": ["raw"],
    "surprises_t": ["stages_t", "turnover"], "implied": ["coarse"], "zs": ["implied", "surprises_t"], "returns": ["coarse"], "tests": ["returns", "zs"], "walk": ["coarse"], "cost_curve": ["walk"],
    "rule_rows": ["coarse", "surprises_t"], "scaled": ["rule_rows"], "learned": ["scaled"], "decided": ["learned"], "backtested": ["decided"],
}


def with_steps(sql: str, steps: tuple[str, ...]) -> str:
    """The final SELECT behind the steps it needs, its floating columns rounded like the queries'."""
    need, todo = set(), list(steps)
    while todo:
        s = todo.pop()
        if s not in need:
            need.add(s)
            todo += NEEDS.get(s, [])
    head = ",\n".join(STEPS[s] for s in ORDER if s in need)
    body = f"final AS ({sql})"
    return f"WITH {head}{',' if head else ''}\n{body}\nSELECT * FROM final"


# Tape, panels


def _ticks(spark, folder):
    return tape.ticks(spark, folder)


def coarse_of_tape(spark: SparkSession, folder: str) -> DataFrame:
    return panel.panel(tape.ticks(spark, folder), tape.stages(spark, folder), COARSE)


def fine_of_tape(spark: SparkSession, folder: str) -> DataFrame:
    return panel.panel(tape.ticks(spark, folder), tape.stages(spark, folder), FINE)


def moves_of_tape(spark: SparkSession, folder: str) -> DataFrame:
    return panel.mid_changes(tape.ticks(spark, folder), tape.stages(spark, folder), TAPE.moves_s)


def _stored(name: str, make):
    """The analyses read panels from the store; it is written by the first that needs it."""
    return lambda spark, folder: session_table(spark, [f"{folder}/events.parquet"], name, lambda: make(spark, folder))


_coarse, _fine, _moves = _stored("coarse", coarse_of_tape), _stored("fine", fine_of_tape), _stored("moves", moves_of_tape)


def _liq(spark: SparkSession, folder: str) -> DataFrame:
    c = _coarse(spark, folder)
    return liquidity.with_baselines(c, panel.baselines(c, TAPE.baseline_s))


def R(*columns: str, **doubles: str) -> str:
    """SELECT list: plain columns, and rounded ones by alias."""
    out = [f'"{c}"' for c in columns]
    out += [f'round(CAST({e} AS DOUBLE), 6) + 0.0 AS "{a}"' for a, e in doubles.items()]
    return ", ".join(out)


def D(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_TOUCH = ["bid_px", "ask_px", "bid_sz", "ask_sz", "spread"]
_COUNTS = ["updates", "trades", "volume", "signed_volume"]
_DEPTHS = [f"depth_{k}" for k in (1, 3, 5, 10)]
_KEYS = ["window_id", "event_type", "stage", "time_et", "instrument"]


@query("SELECT * FROM ticks", ("ticks",))
def tape_frame(spark, folder):
    return tape.ticks(spark, folder)


@query("SELECT window_id, event_type, stage, time_et, day, t0_ns FROM stages_t", ("stages_t",))
def tape_stages(spark, folder):
    return tape.stages(spark, folder)


for _name, _f in (("coarse", coarse_of_tape), ("fine", fine_of_tape)):
    QUERIES[f"asof_panel_{_name}"] = lambda spark, folder, f=_f: rounded(f(spark, folder))
    SQL[f"asof_panel_{_name}"] = with_steps(f"SELECT {R(*_KEYS, 'offset_ms', *_TOUCH, *_DEPTHS, *_COUNTS, **D('mid', 'mid_move'))} FROM {_name}", (_name,))


@query(f"SELECT {R('window_id', 'stage', 'instrument', 'offset_ms', *_COUNTS)} FROM fine", ("fine",))
def interval_counts(spark, folder):
    return _fine(spark, folder).select("window_id", "stage", "instrument", "offset_ms", *_COUNTS)


@query(f"SELECT {R(*_KEYS, 'offset_ns', **D('mid_move'))} FROM moves", ("moves",))
def mid_changes(spark, folder):
    return moves_of_tape(spark, folder)


_BARS = """bars AS (SELECT window_id, instrument, ts_event // 300000000000 * 300000000000 AS ts_event, arg_max(price, seq_ts) AS close, CAST(sum(size) AS BIGINT) AS volume FROM (SELECT *, ts_event AS seq_ts FROM ticks) GROUP BY ALL),
bar_staged AS (SELECT b.*, s.event_type, s.stage, s.time_et, b.ts_event + 300000000000 - s.t0_ns AS off FROM bars b JOIN stages_t s USING (window_id)),
bar_cells AS (SELECT window_id, stage, instrument, CAST(greatest(0, ceil((off - {g.start}) / CAST({g.step} AS DOUBLE))) AS BIGINT) AS j, CAST(sum(volume) AS BIGINT) AS volume FROM bar_staged WHERE off <= {g.end} GROUP BY ALL),
bar_pre AS (SELECT window_id, stage, instrument, arg_max(close, off) AS pre FROM bar_staged WHERE off <= 0 GROUP BY ALL),
bar_spine AS (SELECT * FROM (SELECT DISTINCT window_id, event_type, stage, time_et, instrument FROM bar_staged), coarse_points)""".format(g=COARSE)


@query()
def ohlcv_completed_bars(spark, folder):
    t = tape.ticks(spark, folder).withColumn("open_ns", F.expr("ts_event div 300000000000L * 300000000000L"))
    bars = t.groupBy("window_id", "instrument", F.col("open_ns").alias("ts_event")).agg(F.max_by("price", F.struct(t["ts_event"], "seq")).alias("close"), F.sum("size").alias("volume"))
    return panel.bar_panel(bars, tape.stages(spark, folder), COARSE, bar_ns=300 * 10**9)


SQL["ohlcv_completed_bars"] = with_steps("SELECT 1 AS one", ("coarse_points", "ticks", "stages_t")).replace(
    "final AS (SELECT 1 AS one)",
    f"""{_BARS}, final AS (SELECT s.window_id, s.event_type, s.stage, s.time_et, s.instrument, CAST(s.p // 1000000 AS BIGINT) AS offset_ms, t.close, t.close - r.pre AS close_move, CASE WHEN s.j > 0 THEN coalesce(c.volume, 0) END AS volume
FROM bar_spine s ASOF LEFT JOIN bar_staged t ON s.window_id = t.window_id AND s.stage = t.stage AND s.instrument = t.instrument AND s.p >= t.off
LEFT JOIN bar_cells c ON s.window_id = c.window_id AND s.stage = c.stage AND s.instrument = c.instrument AND s.j = c.j LEFT JOIN bar_pre r ON s.window_id = r.window_id AND s.stage = r.stage AND s.instrument = r.instrument)""",
)


@query(f"SELECT {R('window_id', 'event_type', 'stage', 'instrument', **D(*[f'base_{m}' for m in panel.BASELINE_MEASURES]))} FROM base", ("base",))
def baselines_median(spark, folder):
    return panel.baselines(_coarse(spark, folder), TAPE.baseline_s)


@query(f"""SELECT c.window_id, c.stage, c.instrument, c.offset_ms, c.depth_1, round(b.base_depth_1, 6) AS base_depth_1, round(c.mid, 6) AS mid, m.moves FROM coarse c JOIN base b USING (window_id, event_type, stage, instrument)
LEFT JOIN (SELECT window_id, stage, instrument, count(*) AS moves FROM moves GROUP BY ALL) m ON m.window_id = c.window_id AND m.stage = c.stage AND m.instrument = c.instrument WHERE c.event_type = 'CPI' AND c.instrument = 'click'""", ("base", "moves"))
def panel_store_roundtrip(spark, folder):
    """The whole build job written to a store, and one event type and instrument read back from it, pruned."""
    path = shared_folder(spark, "store")
    build_panels(spark, tape.ticks(spark, folder), tape.stages(spark, folder), TAPE, path, {"folder": folder})
    parts = {p: read_part(spark, path, p).filter("event_type = 'CPI' and instrument = 'click'") for p in ("coarse", "baselines", "moves")}
    keys = ["window_id", "stage", "instrument"]
    moves = parts["moves"].groupBy(*keys).agg(F.count("*").alias("moves"))
    out = parts["coarse"].join(parts["baselines"].select(*keys, "base_depth_1"), keys).join(moves, keys, "left")
    return out.select(*keys, "offset_ms", "depth_1", "base_depth_1", "mid", "moves")


_RATIO = f"""SELECT window_id, event_type, stage, time_et, instrument, CASE WHEN quiet = 0 THEN CASE WHEN spike > 0 THEN CAST('inf' AS DOUBLE) END ELSE spike / quiet END AS ratio FROM (SELECT window_id, event_type, stage, time_et, instrument,
    avg(m) FILTER (offset_ms > {TAPE.quiet_s[0] * 1000} AND offset_ms <= {TAPE.quiet_s[1] * 1000}) AS quiet, avg(m) FILTER (offset_ms > {TAPE.spike_s[0] * 1000} AND offset_ms <= {TAPE.spike_s[1] * 1000}) AS spike
    FROM (SELECT *, abs(mid - lag(mid) OVER (PARTITION BY window_id, stage, instrument ORDER BY offset_ms)) AS m FROM coarse) GROUP BY ALL)"""


@query(f"SELECT {R(*_KEYS, **D('ratio'))} FROM ({_RATIO})", ("coarse",))
def spike_ratio(spark, folder):
    return panel.spike_ratios(_coarse(spark, folder), TAPE.quiet_s, TAPE.spike_s)


@query(f"SELECT window_id AS event_id, round(max(ratio), 6) AS best_ratio, arg_max(instrument, struct_pack(r := ratio, i := instrument)) AS best_instrument, coalesce(max(ratio) >= {TAPE.least_spike_ratio}, false) AS confirmed FROM ({_RATIO}) WHERE instrument IN ('click', 'view') AND ratio IS NOT NULL GROUP BY ALL", ("coarse",))
def validate_events(spark, folder):
    ratios = panel.spike_ratios(_coarse(spark, folder), TAPE.quiet_s, TAPE.spike_s)
    return panel.confirmed_events(ratios.filter("ratio is not null"), TAPE.references, TAPE.least_spike_ratio)


# Liquidity


@query(f"SELECT {R('window_id', 'stage', 'group', 'instrument', 'offset_ms', **D('depth_pct', 'base_depth_1'))} FROM liq", ("liq",))
def depth_pct_of_baseline(spark, folder):
    return _liq(spark, folder).select("window_id", "stage", "group", "instrument", "offset_ms", "depth_pct", "base_depth_1")


@query(
    f"""SELECT {R('group', 'instrument', 'measure', 'offset_s', 'n_nonnull', 'n_events', **D('mean'))} FROM (SELECT "group", instrument, measure, offset_s, avg(value) AS mean, count(value) AS n_nonnull, any_value(n) AS n_events
    FROM points JOIN (SELECT "group", instrument, measure, count(DISTINCT window_id) AS n FROM points GROUP BY ALL) USING ("group", instrument, measure) GROUP BY "group", instrument, measure, offset_s)""",
    ("points",),
)
def liquidity_curves(spark, folder):
    return liquidity.curves(liquidity.curve_points(_liq(spark, folder), TAPE.curve_s))


@query(
    f"""SELECT {R('group', 'instrument', 'offset_s', **D('share'))} FROM (SELECT "group", instrument, offset_s, avg(value) AS share FROM points WHERE measure = 'wide_spread' GROUP BY ALL)""",
    ("points",),
)
def wide_spread_share(spark, folder):
    p = liquidity.curve_points(_liq(spark, folder), TAPE.curve_s).filter("measure = 'wide_spread'")
    return p.groupBy("group", "instrument", "offset_s").agg(F.avg("value").alias("share"))


@query(f"SELECT {R('window_id', 'stage', 'group', 'instrument', 'offset_ms', **D('smooth'))} FROM smooth", ("smooth",))
def rolling_median_edge(spark, folder):
    p = _liq(spark, folder)
    return p.select("window_id", "stage", "group", "instrument", "offset_ms", liquidity.smoothed(p, "depth_pct").alias("smooth"))


_MET = ["min_depth_pct", "max_spread_first_min", "recovery_50_s", "recovery_90_s", "spread_recovery_s"]


@query(f"SELECT {R('window_id', 'stage', 'group', 'instrument', **D(*_MET))} FROM metrics", ("metrics",))
def recovery_times_held(spark, folder):
    return liquidity.event_metrics(_liq(spark, folder), TAPE)


_K = TAPE.segment
_WITHDRAWAL = f"""cut_rows AS (SELECT window_id, stage, "group", instrument, list(struct_pack(x := offset_ms, y := depth_pct) ORDER BY offset_ms) FILTER (depth_pct IS NOT NULL) AS a FROM liq WHERE offset_ms BETWEEN {TAPE.search_s[0] * 1000} AND {TAPE.search_s[1] * 1000} GROUP BY ALL),
cut_s AS (SELECT * EXCLUDE a, a, len(a) AS n, list_transform(range(1, len(a) + 1), lambda i: list_median([a[greatest(1, least(len(a), i + d))].y for d in [-2, -1, 0, 1, 2]])) AS y FROM cut_rows),
cut_b AS (SELECT *, list_transform(range({_K}, n - {_K} + 1), lambda b: struct_pack(c := round(
    list_sum(list_transform(range(1, b), lambda i: pow(y[i + 1] - y[1] - (y[b] - y[1]) / (b - 1) * i, 2))) + list_sum(list_transform(range(b, n), lambda i: pow(y[i + 1] - y[b] - (y[n] - y[b]) / (n - b) * (i - b + 1), 2))), 9), b := b)) AS cs
    FROM cut_s WHERE n >= {3 * _K}),
cut_f AS (SELECT *, list_min(cs).b AS b FROM cut_b),
found AS (SELECT window_id, stage, "group", instrument, CASE WHEN list_median(y[1:b]) - list_median(y[n - {_K} + 1:n]) >= {TAPE.least_drop_pct} THEN a[b + 1].x / 1000.0 END AS withdrawal_start_s FROM cut_f)"""


@query()
def withdrawal_start(spark, folder):
    return liquidity.withdrawal_starts(_liq(spark, folder), TAPE)


SQL["withdrawal_start"] = with_steps("SELECT 1 AS one", ("liq",)).replace(
    "final AS (SELECT 1 AS one)", f"""{_WITHDRAWAL}, final AS (SELECT d.*, round(f.withdrawal_start_s, 6) AS withdrawal_start_s FROM (SELECT DISTINCT window_id, stage, "group", instrument FROM liq) d LEFT JOIN found f USING (window_id, stage, "group", instrument))"""
)


def _events(spark, folder):
    p = _liq(spark, folder)
    return liquidity.event_metrics(p, TAPE).join(liquidity.withdrawal_starts(p, TAPE), liquidity.SERIES)


def _boot(values: str, keys: str, stat: str, reps: int, seed: int, name: str = "boot") -> str:
    """Interval of a statistic over events in SQL: the portable resampler on rows numbered by event."""
    return _boot_sql(values, keys, stat, reps, seed).replace("boot_", f"{name}_")


def _curve_boot(values: str, keys: str, reps: int, seed: int) -> str:
    """Bands of a mean curve in SQL; values: keys, e (the event), pos, v. Gives cb_e (keys, pos, mean, n) and cb_q (keys, pos, lo, hi)."""
    return f"""cb_rows AS ({values}),
cb_ids AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT DISTINCT {keys}, e FROM cb_rows)),
cb_m AS (SELECT {keys}, i, n, pos, v FROM cb_rows JOIN cb_ids USING ({keys}, e)),
cb_d AS (SELECT g.*, r.rep, ((r.rep * {stats.REP_STEP} + s.slot * {stats.SLOT_STEP} + {seed}) * {stats.MULTIPLIER} % {stats.MODULUS}) % n AS i FROM (SELECT DISTINCT {keys}, n FROM cb_ids WHERE n >= 2) g, generate_series(0, {reps - 1}) AS r(rep), generate_series(0, 400) AS s(slot) WHERE s.slot < g.n),
cb_b AS (SELECT {keys}, rep, pos, avg(v) AS b FROM cb_d JOIN (SELECT * EXCLUDE n FROM cb_m) USING ({keys}, i) GROUP BY ALL),
cb_q AS (SELECT {keys}, pos, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM cb_b WHERE b IS NOT NULL GROUP BY ALL),
cb_e AS (SELECT {keys}, pos, avg(v) AS mean, any_value(n) AS n FROM cb_m GROUP BY ALL)"""


def _final(name: str, steps: tuple[str, ...], ctes: str, select: str) -> None:
    """Register SQL that needs more steps than the common ones."""
    SQL[name] = with_steps("SELECT 1 AS one", steps).replace("final AS (SELECT 1 AS one)", f"{ctes}, final AS ({select})")


def _boot_sql(values: str, keys: str, stat: str, reps: int, seed: int) -> str:
    return f"""boot_v AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM ({values}) WHERE v IS NOT NULL),
boot_g AS (SELECT DISTINCT {keys}, n FROM boot_v WHERE n >= 2),
boot_d AS (SELECT g.*, r.rep, ((r.rep * {stats.REP_STEP} + s.slot * {stats.SLOT_STEP} + {seed}) * {stats.MULTIPLIER} % {stats.MODULUS}) % n AS i FROM boot_g g, generate_series(0, {reps - 1}) AS r(rep), generate_series(0, 400) AS s(slot) WHERE s.slot < g.n),
boot_s AS (SELECT {keys}, d.rep, {stat}(v.v) AS b FROM boot_d d JOIN boot_v v USING ({keys}, i) GROUP BY {keys}, d.rep),
boot_q AS (SELECT {keys}, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM boot_s GROUP BY ALL),
boot_e AS (SELECT {keys}, {stat}(v) AS estimate, count(v) AS n FROM ({values}) GROUP BY ALL)"""


@query()
def liquidity_summary(spark, folder):
    return liquidity.summary(liquidity.event_metrics(_liq(spark, folder), TAPE), _MET, TAPE)


_BV = f"""SELECT "group", instrument, window_id AS e, unnest({_MET!r}) AS metric, unnest([{', '.join(_MET)}]) AS v FROM metrics"""
SQL["liquidity_summary"] = with_steps("SELECT 1 AS one", ("metrics",)).replace(
    "final AS (SELECT 1 AS one)",
    _boot(_BV, '"group", instrument, metric', "median", TAPE.reps, TAPE.seed)
    + f""", final AS (SELECT {R('group', 'instrument', 'metric', 'n', **D('estimate', 'lo', 'hi'))} FROM boot_e LEFT JOIN boot_q USING ("group", instrument, metric))""",
)


@query()
def liquidity_against_controls(spark, folder):
    return liquidity.against_controls(liquidity.summary(_events(spark, folder), liquidity.METRICS, TAPE))


@query()
def bootstrap_curve_ci(spark, folder):
    p = liquidity.curve_points(_liq(spark, folder), TAPE.curve_s).filter("measure = 'depth_pct'")
    return stats.curve_intervals(p, ["group", "instrument"], "window_id", "offset_s", "value", TAPE.reps, TAPE.seed)


SQL["bootstrap_curve_ci"] = with_steps("SELECT 1 AS one", ("points",)).replace(
    "final AS (SELECT 1 AS one)",
    f"""ids AS (SELECT *, row_number() OVER (PARTITION BY "group", instrument ORDER BY window_id) - 1 AS i, count(*) OVER (PARTITION BY "group", instrument) AS n FROM (SELECT DISTINCT "group", instrument, window_id FROM points)),
m AS (SELECT "group", instrument, i.i, i.n, offset_s, value FROM points p JOIN ids i USING ("group", instrument, window_id) WHERE measure = 'depth_pct'),
d AS (SELECT g.*, r.rep, ((r.rep * {stats.REP_STEP} + s.slot * {stats.SLOT_STEP} + {TAPE.seed}) * {stats.MULTIPLIER} % {stats.MODULUS}) % n AS i FROM (SELECT DISTINCT "group", instrument, n FROM ids WHERE n >= 2) g, generate_series(0, {TAPE.reps - 1}) AS r(rep), generate_series(0, 400) AS s(slot) WHERE s.slot < g.n),
b AS (SELECT d."group", d.instrument, d.rep, m.offset_s, avg(m.value) AS b FROM d JOIN m USING ("group", instrument, i) GROUP BY ALL),
q AS (SELECT "group", instrument, offset_s, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM b WHERE b IS NOT NULL GROUP BY ALL),
e AS (SELECT "group", instrument, offset_s, avg(value) AS mean, any_value(n) AS n_events FROM m GROUP BY ALL),
final AS (SELECT {R('group', 'instrument', 'offset_s', 'n_events', **D('mean', 'lo', 'hi'))} FROM e LEFT JOIN q USING ("group", instrument, offset_s))""",
)


_final(
    "liquidity_against_controls", ("metrics",),
    _WITHDRAWAL + f""", evs AS (SELECT m.*, f.withdrawal_start_s FROM metrics m LEFT JOIN found f USING (window_id, stage, "group", instrument)), """
    + _boot(f"""SELECT "group", instrument, window_id AS e, unnest({liquidity.METRICS!r}) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in liquidity.METRICS)}]) AS v FROM evs""", '"group", instrument, metric', "median", TAPE.reps, TAPE.seed),
    f"""SELECT c.cg AS control_group, {', '.join(f'e."{k}"' for k in ('group', 'instrument', 'metric', 'n'))}, {', '.join(f'round({k}, 6) + 0.0 AS {k}' for k in ('lo', 'hi'))}, round(e.estimate, 6) + 0.0 AS estimate, round(k.estimate, 6) + 0.0 AS control_estimate, k.n AS n_control
    FROM boot_e e JOIN (VALUES ('CPI release', 'CONTROL 08:30'), ('NFP release', 'CONTROL 08:30'), ('FOMC statement', 'CONTROL 14:00'), ('FOMC press conference', 'CONTROL 14:30')) c(g, cg) ON e."group" = c.g
    LEFT JOIN boot_q q ON q."group" = e."group" AND q.instrument = e.instrument AND q.metric = e.metric LEFT JOIN boot_e k ON k."group" = c.cg AND k.instrument = e.instrument AND k.metric = e.metric""",
)


@query()
def curve_bands(spark, folder):
    """The curves of all four measures with their bands."""
    p = liquidity.curve_points(_liq(spark, folder), TAPE.curve_s)
    return stats.curve_intervals(p, ["group", "instrument", "measure"], "window_id", "offset_s", "value", TAPE.reps, TAPE.seed)


_final(
    "curve_bands", ("points",), _curve_boot("""SELECT "group", instrument, measure, window_id AS e, offset_s AS pos, value AS v FROM points""", '"group", instrument, measure', TAPE.reps, TAPE.seed),
    f"""SELECT {R('group', 'instrument', 'measure', **D('mean', 'lo', 'hi'))}, pos AS offset_s, n AS n_events FROM cb_e LEFT JOIN cb_q USING ("group", instrument, measure, pos)""",
)


# Reaction


@query("SELECT instrument, round(k_ticks, 6) AS k_ticks, control_steps FROM k", ("k",))
def first_move_threshold(spark, folder):
    return reaction.thresholds(_fine(spark, folder), TAPE.first_move_quantile)


def _first(spark, folder):
    return reaction.first_moves(_moves(spark, folder), reaction.thresholds(_fine(spark, folder), TAPE.first_move_quantile))


@query(f"SELECT {R('window_id', 'event_type', 'stage', 'instrument', **D('first_move_ms', 'first_move_ticks'))} FROM first", ("first",))
def first_moves(spark, folder):
    return _first(spark, folder)


@query(
    f"""SELECT {R('event_type', 'stage', 'instrument', 'events', 'events_with_move', 'paired_events', **D('median_first_move_ms', 'median_minus_ref_ms'))} FROM (SELECT event_type, stage, instrument, count(*) AS events, count(first_move_ms) AS events_with_move,
    median(first_move_ms) AS median_first_move_ms, median(first_move_ms - ref) AS median_minus_ref_ms, count(first_move_ms - ref) AS paired_events FROM (SELECT *, max(CASE WHEN instrument = '{TAPE.reference}' THEN first_move_ms END) OVER (PARTITION BY window_id, event_type, stage) AS ref FROM first) GROUP BY ALL)""",
    ("first",),
)
def first_mover_ranking(spark, folder):
    return reaction.ranking(_first(spark, folder), TAPE).drop("lo", "hi", "diff_lo", "diff_hi")


@query()
def first_mover_intervals(spark, folder):
    """The ranking with the intervals of both medians."""
    return reaction.ranking(_first(spark, folder), TAPE)


_LEADS = f"SELECT *, first_move_ms - max(CASE WHEN instrument = '{TAPE.reference}' THEN first_move_ms END) OVER (PARTITION BY window_id, event_type, stage) AS lead_ms FROM first"
_FK = "event_type, stage, instrument"
_final(
    "first_mover_intervals", ("first",),
    f"leads AS ({_LEADS}), " + _boot(f"SELECT {_FK}, window_id AS e, first_move_ms AS v FROM leads", _FK, "median", TAPE.reps, TAPE.seed + 1, "own") + ", " + _boot(f"SELECT {_FK}, window_id AS e, lead_ms AS v FROM leads", _FK, "median", TAPE.reps, TAPE.seed + 1, "pair"),
    f"""SELECT {_FK}, events, o.n AS events_with_move, p.n AS paired_events, round(o.estimate, 6) + 0.0 AS median_first_move_ms, round(oq.lo, 6) + 0.0 AS lo, round(oq.hi, 6) + 0.0 AS hi, round(p.estimate, 6) + 0.0 AS median_minus_ref_ms, round(pq.lo, 6) + 0.0 AS diff_lo, round(pq.hi, 6) + 0.0 AS diff_hi
    FROM (SELECT {_FK}, count(*) AS events FROM first GROUP BY ALL) JOIN own_e o USING ({_FK}) JOIN pair_e p USING ({_FK}) LEFT JOIN own_q oq USING ({_FK}) LEFT JOIN pair_q pq USING ({_FK})""",
)


@query(f"SELECT {R('window_id', 'event_type', 'stage', 'instrument', 'horizon_s', **D('mid_move', 'abs_move_ticks', 'vol_1s', 'abs_move_vol'))} FROM jumps", ("jumps",))
def jump_sizes(spark, folder):
    return reaction.jump_sizes(_coarse(spark, folder), TAPE)


@query(
    f"""SELECT {R('event_type', 'stage', 'instrument', 'horizon_s', 'events', **D('median_abs_move_ticks', 'median_abs_move_vol_units'))} FROM (SELECT event_type, stage, instrument, horizon_s, count(*) AS events, median(abs_move_ticks) AS median_abs_move_ticks, median(abs_move_vol) AS median_abs_move_vol_units FROM jumps GROUP BY ALL)""",
    ("jumps",),
)
def jump_summary(spark, folder):
    return reaction.jump_summary(reaction.jump_sizes(_coarse(spark, folder), TAPE))


@query(f"SELECT {R('window_id', 'event_type', 'stage', 'instrument', 'lag_ms', **D('corr'))} FROM lagged", ("lagged",))
def lead_lag_corr(spark, folder):
    return reaction.lagged_correlations(_fine(spark, folder), TAPE)


@query()
def lead_lag_bands(spark, folder):
    return reaction.lead_lag(_fine(spark, folder), TAPE)


_final(
    "lead_lag_bands", ("lagged",), _curve_boot("SELECT event_type, instrument, window_id || '/' || stage AS e, lag_ms AS pos, corr AS v FROM lagged", "event_type, instrument", TAPE.reps, TAPE.seed + 1),
    "SELECT event_type, instrument, pos AS lag_ms, round(mean, 6) + 0.0 AS corr, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, n AS events FROM cb_e LEFT JOIN cb_q USING (event_type, instrument, pos)",
)


# Regression


def _z(spark, folder):
    s = tape.surprises(spark, folder)
    sd = s.groupBy("event_type").agg(F.stddev_samp("surprise").alias("sd"))
    own = s.join(sd, "event_type").filter("sd > 1e-9").select("event_id", "event_type", (F.col("surprise") / F.col("sd")).alias("z"))
    return own.unionByName(regression.implied_surprises(_coarse(spark, folder), TAPE).select("event_id", "event_type", "z"))


def _tests(spark, folder):
    return cut(regression.tests(regression.returns_at_horizons(_coarse(spark, folder), TAPE), _z(spark, folder)))


@query("SELECT event_id, event_type, round(z, 6) + 0.0 AS z, round(move_ticks, 6) + 0.0 AS move_ticks FROM implied", ("implied",))
def fomc_implied_surprise(spark, folder):
    return regression.implied_surprises(_coarse(spark, folder), TAPE)


@query(f"SELECT {R('window_id', 'event_type', 'stage', 'instrument', 'horizon_s', **D('ret_ticks', 'ret_bps'))}, round(-ret_bps / CASE instrument WHEN 'click' THEN 6.3 WHEN 'view' THEN 1.9 END, 6) + 0.0 AS approx_dyield_bp FROM returns", ("returns",))
def returns_at_horizons(spark, folder):
    return regression.returns_at_horizons(_coarse(spark, folder), TAPE, {"click": 6.3, "view": 1.9})


_TESTS = ["event_type", "stage", "instrument", "horizon_s", "unit"]


def ols_sql(rows: str, keys: list[str], x: str, y: str, name: str = "o") -> str:
    k = ", ".join(f'"{c}"' for c in keys)
    return f"""{name}_m AS (SELECT {k}, {x} AS x, {y} AS y, count(*) OVER g AS n, avg({x}) OVER g AS mx, avg({y}) OVER g AS my, max({x}) OVER g > min({x}) OVER g AS varied FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL WINDOW g AS (PARTITION BY {k})),
{name}_s AS (SELECT {k}, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(varied) AS varied, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM {name}_m GROUP BY {k}),
{name}_b AS (SELECT *, CASE WHEN n >= 3 AND varied THEN sxy / nullif(sxx, 0) END AS beta FROM {name}_s),
{name}_r AS (SELECT {k}, sum(power((m.x - m.mx) * ((m.y - m.my) - b.beta * (m.x - m.mx)) / CASE WHEN abs(1 - 1.0 / b.n - (m.x - m.mx) * (m.x - m.mx) / nullif(b.sxx, 0)) > 1e-12 THEN 1 - 1.0 / b.n - (m.x - m.mx) * (m.x - m.mx) / nullif(b.sxx, 0) END, 2)) AS v,
    count(*) FILTER (NOT coalesce(abs(1 - 1.0 / b.n - (m.x - m.mx) * (m.x - m.mx) / nullif(b.sxx, 0)) > 1e-12, false) AND m.x <> m.mx) AS fullp, sum(power((m.y - m.my) - b.beta * (m.x - m.mx), 2)) AS sse FROM {name}_m m JOIN {name}_b b USING ({k}) GROUP BY {k}),
{name}_f AS (SELECT {k}, coalesce(b.n, 0) AS n_events, b.my - b.beta * b.mx AS alpha, b.beta, CASE WHEN b.beta IS NOT NULL AND r.fullp = 0 THEN sqrt(r.v) / b.sxx END AS se_hc3, CASE WHEN b.beta IS NOT NULL THEN 1 - r.sse / nullif(b.syy, 0) END AS r2
    FROM (SELECT DISTINCT {k} FROM {rows}) LEFT JOIN {name}_b b USING ({k}) LEFT JOIN {name}_r r USING ({k})),
{name} AS (SELECT *, beta / nullif(se_hc3, 0) AS t FROM {name}_f)"""


@query()
def ols_hc3(spark, folder):
    return stats.ols_hc3(_tests(spark, folder), _TESTS, "z", "ret")


SQL["ols_hc3"] = with_steps("SELECT 1 AS one", ("tests",)).replace(
    "final AS (SELECT 1 AS one)", ols_sql("tests", _TESTS, "z", "ret") + f", final AS (SELECT {R(*_TESTS, 'n_events', **D('alpha', 'beta', 'se_hc3', 't', 'r2'))} FROM o)"
)


@query()
def asymmetry_betas(spark, folder):
    return regression.fits(_tests(spark, folder)).select(*_TESTS, "n_events", "beta", "n_pos", "n_neg", "beta_pos", "beta_neg")


SQL["asymmetry_betas"] = with_steps("SELECT 1 AS one", ("tests",)).replace(
    "final AS (SELECT 1 AS one)",
    ",\n".join(ols_sql("tests", _TESTS, x, "ret", n) for x, n in (("z", "o"), ("z_pos", "op"), ("z_neg", "om")))
    + f""", sides AS (SELECT {', '.join(_TESTS)}, count(*) FILTER (z > 0) AS n_pos, count(*) FILTER (z < 0) AS n_neg FROM tests GROUP BY ALL),
final AS (SELECT {', '.join(f'o.{c}' for c in _TESTS)}, o.n_events, round(o.beta, 6) + 0.0 AS beta, n_pos, n_neg, CASE WHEN n_pos >= 3 THEN round(op.beta, 6) + 0.0 END AS beta_pos, CASE WHEN n_neg >= 3 THEN round(om.beta, 6) + 0.0 END AS beta_neg
FROM o JOIN sides USING ({', '.join(_TESTS)}) JOIN op USING ({', '.join(_TESTS)}) JOIN om USING ({', '.join(_TESTS)}))""",
)


@query()
def regression_table(spark, folder):
    expected = {t: {"click": -1, "view": 1, "error": 0} for t in ("CPI", "NFP", "FOMC")}
    return regression.regressions(regression.returns_at_horizons(_coarse(spark, folder), TAPE), _z(spark, folder), TAPE, expected)


@query()
def robustness_labels(spark, folder):
    table = regression.judged(regression.fits(_tests(spark, folder)), TAPE, {})
    return regression.robustness(table, TAPE.robust_events).select(*_TESTS, "beta", "n_events", "q_bh", "survives_fdr", "label")


@query()
def bootstrap_slope_ci(spark, folder):
    t = _tests(spark, folder).filter("unit = 'ret_ticks'")
    return stats.slope_intervals(t, ["event_type", "instrument", "horizon_s"], "window_id", "z", "ret", TAPE.reps, TAPE.seed)


_SK = "event_type, instrument, horizon_s"
SQL["bootstrap_slope_ci"] = with_steps("SELECT 1 AS one", ("tests",)).replace(
    "final AS (SELECT 1 AS one)",
    f"""v AS (SELECT {_SK}, z, ret, row_number() OVER (PARTITION BY {_SK} ORDER BY window_id) - 1 AS i, count(*) OVER (PARTITION BY {_SK}) AS n FROM tests WHERE unit = 'ret_ticks' AND z IS NOT NULL AND ret IS NOT NULL),
d AS (SELECT g.*, r.rep, ((r.rep * {stats.REP_STEP} + s.slot * {stats.SLOT_STEP} + {TAPE.seed}) * {stats.MULTIPLIER} % {stats.MODULUS}) % n AS i FROM (SELECT DISTINCT {_SK}, n FROM v WHERE n >= 3) g, generate_series(0, {TAPE.reps - 1}) AS r(rep), generate_series(0, 400) AS s(slot) WHERE s.slot < g.n),
b AS (SELECT {_SK}, rep, regr_slope(v.ret, v.z) AS b FROM d JOIN v USING ({_SK}, i) GROUP BY {_SK}, rep HAVING max(v.z) > min(v.z)),
q AS (SELECT {_SK}, quantile_cont(b, 0.025) AS boot_lo, quantile_cont(b, 0.975) AS boot_hi FROM b GROUP BY ALL),
final AS (SELECT {R('event_type', 'instrument', 'horizon_s', **D('boot_lo', 'boot_hi'))} FROM (SELECT DISTINCT {_SK} FROM tests) LEFT JOIN q USING ({_SK}))""",
)


@query()
def continuation(spark, folder):
    return regression.continuation(_coarse(spark, folder), TAPE).drop("p")


_C = [s * 1000 for s in TAPE.continuation_s]
_CW = [f"+{_C[0] // 60000} min to +{m // 60000} min" for m in _C[1:]]
SQL["continuation"] = with_steps("SELECT 1 AS one", ("coarse",)).replace(
    "final AS (SELECT 1 AS one)",
    f"""wide AS (SELECT window_id, event_type, instrument, {', '.join(f'max(mid_move) FILTER (offset_ms = {m}) AS m{m}' for m in _C)} FROM coarse WHERE event_type <> 'CONTROL' AND stage = CASE event_type WHEN 'FOMC' THEN 'statement' ELSE 'release' END AND offset_ms IN ({', '.join(map(str, _C))}) GROUP BY ALL),
long AS (SELECT event_type, instrument, m{_C[0]} AS x1, unnest({_CW!r}) AS "window", unnest([{', '.join(f'm{m} - m{_C[0]}' for m in _C[1:])}]) AS y1 FROM wide),
{ols_sql('long', ['event_type', 'instrument', 'window'], 'x1', 'y1')},
final AS (SELECT {R('event_type', 'instrument', 'window', 'n_events', **D('beta', 't'))}, CASE WHEN beta > 0 THEN 'continuation' WHEN beta < 0 THEN 'reversal' ELSE 'none' END AS reading FROM o)""",
)


# Execution


@query(f"SELECT {R('window_id', 'group', 'instrument', 'offset_s', 'qty', 'insufficient_depth', **D('buy_ticks', 'sell_ticks'))}, round((buy_ticks + sell_ticks) / 2, 6) + 0.0 AS cost_ticks, round({TAPE.fee_usd} / tick_usd, 6) AS fee_ticks, tick_usd FROM walk JOIN (VALUES {', '.join(f"('{i}', CAST({u} AS DOUBLE))" for i, u in TICK_USD.items())}) v(instrument, tick_usd) USING (instrument)", ("walk",))
def book_walk_cost(spark, folder):
    rows = execution.costs(tape.ticks(spark, folder), tape.stages(spark, folder), COARSE, TAPE.order_sizes)
    return execution.with_fees(rows.join(_definitions(spark), "instrument", "left"), TAPE.fee_usd, F.col("tick_usd"))


def _costs(spark, folder):
    return execution.costs(tape.ticks(spark, folder), tape.stages(spark, folder), COARSE, TAPE.order_sizes)


@query(f"SELECT {R('group', 'instrument', 'qty', 'offset_s', 'n_events', **D('mean_ticks', 'share_insufficient'))} FROM cost_curve", ("cost_curve",))
def execution_cost_curve(spark, folder):
    return execution.curves(_costs(spark, folder))


@query()
def execution_cost_bands(spark, folder):
    return execution.curve_bands(_costs(spark, folder), TAPE)


_final(
    "execution_cost_bands", ("walk",), _curve_boot("""SELECT "group", instrument, qty, window_id AS e, offset_s AS pos, (buy_ticks + sell_ticks) / 2 AS v FROM walk""", '"group", instrument, qty', TAPE.reps, TAPE.seed + 3),
    f"""SELECT {R('group', 'instrument', 'qty', **D('mean', 'lo', 'hi'))}, pos AS offset_s, n AS n_events FROM cb_e LEFT JOIN cb_q USING ("group", instrument, qty, pos)""",
)


@query(
    f"""SELECT {R('group', 'instrument', 'qty', 'n_events', 'n_control', **D('normal_ticks', 'first_5s_ticks', 'extra_first_5s_ticks', 'seconds_to_normal', 'max_share_insufficient'))} FROM (SELECT "group", instrument, qty, normal_ticks, n_control, max(n_events) AS n_events,
    avg(mean_ticks) FILTER (offset_s >= 0 AND offset_s < {TAPE.early_s}) AS first_5s_ticks, avg(mean_ticks) FILTER (offset_s >= 0 AND offset_s < {TAPE.early_s}) - normal_ticks AS extra_first_5s_ticks, min(offset_s) FILTER (h = {TAPE.hold} AND offset_s >= 0) AS seconds_to_normal, max(share_insufficient) AS max_share_insufficient
    FROM (SELECT c.*, n.normal_ticks, n.n_control, sum(CASE WHEN c.mean_ticks <= {TAPE.normal_multiple} * n.normal_ticks THEN 1 ELSE 0 END) OVER (PARTITION BY c."group", c.instrument, c.qty ORDER BY offset_s ROWS BETWEEN CURRENT ROW AND {TAPE.hold - 1} FOLLOWING) AS h
    FROM cost_curve c JOIN (SELECT "group" AS cg, instrument, qty, median(mean_ticks) AS normal_ticks, max(n_events) AS n_control FROM cost_curve GROUP BY ALL) n ON n.instrument = c.instrument AND n.qty = c.qty
    AND n.cg = CASE c."group" WHEN 'CPI release' THEN 'CONTROL 08:30' WHEN 'NFP release' THEN 'CONTROL 08:30' WHEN 'FOMC statement' THEN 'CONTROL 14:00' WHEN 'FOMC press conference' THEN 'CONTROL 14:30' END) GROUP BY "group", instrument, qty, normal_ticks, n_control)""",
    ("cost_curve",),
)
def seconds_to_normal(spark, folder):
    return execution.back_to_normal(execution.curves(_costs(spark, folder)), TAPE)


# Strategy


def _rules(spark, folder):
    return strategy.trades(_coarse(spark, folder), tape.surprises(spark, folder), TAPE)


def _definitions(spark):
    return spark.createDataFrame(list(TICK_USD.items()), "instrument string, tick_usd double")


def _backtest(spark, folder):
    return strategy.backtest(_coarse(spark, folder), tape.surprises(spark, folder), TAPE, _definitions(spark))


_RULE = ["event_type", "instrument", "delay_s", "exit_s"]


@query(f"SELECT {R(*_RULE, 'event_id', 'k', **D('z', 'sign_mapping', 'threshold', 'direction'))} FROM decided", ("decided",))
def walk_forward_rule(spark, folder):
    return strategy.walk_forward(_rules(spark, folder), TAPE).select(*_RULE, "event_id", F.col("k").cast("long").alias("k"), "z", "sign_mapping", "threshold", "direction")


_BT = ["z", "threshold", "sign_mapping", "direction", "gross_ticks", "net_ticks", "net_usd", "upper_bound_net_ticks", "random_net_ticks"]


@query(f"SELECT {R(*_RULE, 'event_id', 'release_date', 'training_only', **D(*_BT))} FROM backtested", ("backtested",))
def strategy_trades(spark, folder):
    return _backtest(spark, folder)


_SUM = f"""SELECT {', '.join(_RULE)}, count(*) AS events, count(*) FILTER (training_only) AS training_events, count(net_ticks) AS trades, avg(net_ticks) AS mean_net_ticks, avg(CASE WHEN net_ticks > 0 THEN 1.0 WHEN net_ticks IS NOT NULL THEN 0.0 END) AS hit_rate,
    min(net_ticks) AS worst_net_ticks, avg(net_usd) AS mean_net_usd, avg(upper_bound_net_ticks) AS upper_bound_mean_net_ticks, avg(random_net_ticks) AS random_mean_net_ticks FROM backtested GROUP BY ALL"""
_SD = ["mean_net_ticks", "hit_rate", "worst_net_ticks", "mean_net_usd", "upper_bound_mean_net_ticks", "random_mean_net_ticks"]


@query(f"SELECT {R(*_RULE, 'events', 'training_events', 'trades', **D(*_SD))} FROM ({_SUM})", ("backtested",))
def strategy_summary(spark, folder):
    return strategy.summary(_backtest(spark, folder))


@query()
def strategy_summary_intervals(spark, folder):
    return strategy.summary_with_intervals(_backtest(spark, folder), TAPE)


_final(
    "strategy_summary_intervals", ("backtested",), _boot(f"SELECT {', '.join(_RULE)}, event_id AS e, net_ticks AS v FROM backtested", ", ".join(_RULE), "avg", TAPE.reps, 7) + f", sums AS ({_SUM})",
    f"""SELECT {R(*_RULE, 'events', 'training_events', 'trades', **D(*_SD))}, round(lo, 6) + 0.0 AS ci_lo, round(hi, 6) + 0.0 AS ci_hi FROM sums LEFT JOIN boot_q USING ({', '.join(_RULE)})""",
)


@query(f"SELECT event_type, instrument, delay_s, exit_s, round(mean_net_ticks, 6) + 0.0 AS mean_net_ticks, trades FROM ({_SUM}) WHERE mean_net_ticks IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean_net_ticks DESC, instrument, delay_s, exit_s) = 1", ("backtested",))
def best_rules(spark, folder):
    return strategy.best_rules(strategy.summary(_backtest(spark, folder)))


@query(f"SELECT {', '.join(_RULE)}, event_id, release_date, round(sum(coalesce(net_ticks, 0)) OVER (PARTITION BY {', '.join(_RULE)} ORDER BY release_date, event_id), 6) + 0.0 AS running_net_ticks FROM backtested", ("backtested",))
def cumulative_pnl(spark, folder):
    return strategy.cumulative(_backtest(spark, folder))

# Small steps of the above, each by itself


@query(f"SELECT window_id, instrument, seq, {', '.join('+'.join(f'bid_sz_{i} + ask_sz_{i}' for i in range(k)) + f' AS depth_{k}' for k in (1, 3, 5, 10))}, CAST(NULL AS BIGINT) AS depth_20 FROM ticks", ("ticks",))
def depth_at_levels(spark, folder):
    """Depth over the first levels of both sides; more levels than the source has are NULL."""
    t = tape.ticks(spark, folder)
    return t.select("window_id", "instrument", "seq", *[panel.depth(k, tape.LEVELS).alias(f"depth_{k}") for k in (1, 3, 5, 10, 20)])


@query("SELECT window_id, instrument, seq, ask_px_0 - bid_px_0 AS spread, (bid_px_0 + ask_px_0) / 2.0 AS mid, action IN (3, 4) AS traded, CASE WHEN side = 1 THEN size ELSE -size END AS signed_size FROM ticks", ("ticks",))
def touch_spread_mid(spark, folder):
    t = tape.ticks(spark, folder)
    return t.select("window_id", "instrument", "seq", (F.col("ask_px_0") - F.col("bid_px_0")).alias("spread"), panel.touch_mid().alias("mid"), panel.is_trade().alias("traded"), (F.col("size") * panel.signed()).alias("signed_size"))


@query(f"SELECT {R('window_id', 'stage', 'instrument', **D('pre_mid'))} FROM pre", ("pre",))
def pre_release_mid(spark, folder):
    """The mid of the last update strictly before t0; NULL if that book was one-sided."""
    t = panel.staged(tape.ticks(spark, folder), tape.stages(spark, folder), ["window_id"]).filter("off < 0")
    return t.groupBy("window_id", "stage", "instrument").agg(F.max(F.struct("ts_event", "seq", panel.touch_mid().alias("mid")))["mid"].alias("pre_mid"))


@query("""SELECT "group", instrument, round(avg(updates), 6) AS updates_per_step, round(avg(trades), 6) AS trades_per_step, round(avg(volume), 6) AS volume_per_step FROM liq GROUP BY ALL""", ("liq",))
def activity_rates(spark, folder):
    return _liq(spark, folder).groupBy("group", "instrument").agg(*[F.avg(c).alias(f"{c}_per_step") for c in ("updates", "trades", "volume")])


@query("""SELECT "group", instrument, qty, round(avg(CASE WHEN insufficient_depth THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) FILTER (insufficient_depth) AS points FROM walk GROUP BY ALL""", ("walk",))
def insufficient_depth_share(spark, folder):
    short = F.col("insufficient_depth")
    return _costs(spark, folder).groupBy("group", "instrument", "qty").agg(F.avg(F.coalesce(short, F.lit(False)).cast("int")).alias("share"), F.count_if(short).alias("points"))


@query()
def case_sign_check(spark, folder):
    """Signs of the slopes against an expectation by instrument; survival stands for |t| > 2."""
    o = stats.ols_hc3(_tests(spark, folder), _TESTS, "z", "ret")
    expected = F.coalesce(regression.mapped({"click": -1, "view": 1}, F.col("instrument"), "int"), F.lit(0))
    survives = F.coalesce(F.abs("t") > 2, F.lit(False))
    return o.select(*_TESTS, regression.sign_check(expected, F.col("beta"), survives).alias("sign_check"))


SQL["case_sign_check"] = with_steps("SELECT 1 AS one", ("tests",)).replace(
    "final AS (SELECT 1 AS one)",
    ols_sql("tests", _TESTS, "z", "ret")
    + f""", final AS (SELECT {', '.join(_TESTS)}, CASE WHEN coalesce(CASE instrument WHEN 'click' THEN -1 WHEN 'view' THEN 1 END, 0) = 0 THEN 'no expectation' WHEN sign(beta) = CASE instrument WHEN 'click' THEN -1 WHEN 'view' THEN 1 END THEN 'as expected'
WHEN coalesce(abs(t) > 2, false) THEN 'WRONG SIGN: investigate' ELSE 'unexpected but not significant' END AS sign_check FROM o)""",
)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
