import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.operators.counter_grid import Grid
from tidegrid.operators.panel import bar_panel, baselines, mid_changes, panel

T0 = 1_741_782_600 * 10**9
S, MS = 10**9, 10**6
BOOK = "window_id string, instrument string, seq long, ts_event long, action int, side int, price long, size long, bid_px_0 long, ask_px_0 long, bid_sz_0 long, ask_sz_0 long"


def stages(spark, t0=T0):
    return spark.createDataFrame([("w", "CPI", "release", "08:30", t0)], "window_id string, event_type string, stage string, time_et string, t0_ns long")


def book(spark, rows):
    return spark.createDataFrame([("w", "ZN", i, T0 + o, a, s, b, z, b, k, bs, ks) for i, (o, a, s, z, b, k, bs, ks) in enumerate(rows)], BOOK)


def on_grid(spark, rows, start, end, step):
    g = Grid("g", start * MS, end * MS, step * MS, 1 << 62)
    return {r["offset_ms"]: r for r in panel(book(spark, rows), stages(spark), g).collect()}


def test_jump_at_release_and_first_interval(spark):
    rows = [(-2 * S, 2, 1, 1, 100, 101, 5, 5), (-1, 2, 1, 1, 100, 101, 5, 5), (0, 3, -1, 30, 96, 97, 5, 5), (150 * MS, 2, 1, 1, 96, 98, 5, 5)]
    p = on_grid(spark, rows, -1000, 1000, 100)
    assert [p[o]["mid_move"] for o in (-100, 0, 100, 200)] == [0, -4, -4, -3.5]
    assert [p[o]["spread"] for o in (-100, 0, 200)] == [1, 1, 2]
    assert (p[0]["trades"], p[0]["signed_volume"], p[-100]["trades"], p[-1000]["trades"]) == (1, -30, 0, None)


def test_counts_and_depth(spark):
    p = on_grid(spark, [(k * 250 * MS, 2, 1, 1, 100, 101, 10 + k, 20 + k) for k in range(8)], 0, 1000, 500)
    assert [p[o]["updates"] for o in (0, 500, 1000)] == [None, 2, 2]
    assert [p[o]["depth_1"] for o in (0, 500, 1000)] == [30, 34, 38] and all(r["depth_3"] is None for r in p.values())


def test_one_sided_ties_and_late_series(spark):
    p = on_grid(spark, [(0, 2, 1, 1, 100, 101, 1, 1), (0, 2, 1, 1, 102, None, 7, 8), (600 * MS, 2, 1, 1, 100, 101, 1, 1)], 0, 1000, 500)
    assert (p[0]["bid_px"], p[0]["mid"], p[0]["bid_sz"], p[0]["depth_1"]) == (None, None, 7, 15)
    late = on_grid(spark, [(9 * S, 2, 1, 1, 100, 101, 1, 1)], 0, 1000, 500)
    assert [(r["mid"], r["updates"]) for _, r in sorted(late.items())] == [(None, None), (None, 0), (None, 0)]


def test_baseline_median(spark):
    steps = [(-1500, 10), (-1200, 30), (-900, 20), (-700, 1000), (-300, 5)]
    df = book(spark, [(o * S, 2, 1, 1, 100, 101, d, 0) for o, d in steps])
    p = panel(df, stages(spark), Grid("g", -1800 * S, 0, S, 1 << 62))
    assert baselines(p, (-1800, -600)).first()["base_depth_1"] == 20


def test_mid_changes_at_exact_times(spark):
    df = book(spark, [(-5, 2, 1, 1, 100, 101, 1, 1), (3_000_001, 2, 1, 1, 96, 97, 1, 1), (3_000_001, 2, 1, 1, 96, 97, 9, 1), (3_000_002, 2, 1, 1, 96, 98, 1, 1)])
    for least in (500_000, 1):
        got = [(r["offset_ns"], r["mid_move"]) for r in mid_changes(df, stages(spark), (-60, 120), piece=least).orderBy("offset_ns").collect()]
        assert got == [(-5, 0.0), (3_000_001, -4.0), (3_000_002, -3.5)]


def test_completed_bars(spark):
    bars = spark.createDataFrame([("w", "ZN", T0 + k * S, c, 5) for k, c in ((-1, 100), (0, 104), (1, 103))], "window_id string, instrument string, ts_event long, close long, volume long")
    got = {r["offset_ms"]: r["close_move"] for r in bar_panel(bars, stages(spark), Grid("g", 0, 2 * S, S, 1 << 62)).collect()}
    assert got == {0: 0, 1000: 4, 2000: 3}


@given(st.lists(st.tuples(st.integers(-1500, 1500), st.integers(90, 110)), min_size=1, max_size=12), st.integers(-1000, 1000))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_no_look_ahead(spark, ticks, cut):
    rows = [(o * MS, 2, 1, 1, b, b + 1, 5, 5) for o, b in sorted(ticks)]
    whole, past = on_grid(spark, rows, -1000, 1000, 250), on_grid(spark, [r for r in rows if r[0] <= cut * MS], -1000, 1000, 250)
    for o, r in past.items():
        if o <= cut:
            assert all(r[c] == whole[o][c] for c in ("mid", "depth_1", "updates", "spread"))


def test_columns_that_clash(spark):
    df = book(spark, [(0, 2, 1, 1, 100, 101, 5, 5)]).withColumn("event_type_x", F.lit("t")).withColumn("cell", F.lit(3))
    assert panel(df, stages(spark), Grid("g", 0, S, S, 1 << 62)).count() == 2
    assert panel(df.limit(0), stages(spark), Grid("g", 0, S, S, 1 << 62)).count() == 0


@pytest.mark.parametrize("piece", [8, 500_000])
def test_running_sums(spark, piece):
    from tidegrid.functions.previous import running

    rows = [("h" if k % 5 else None, k // 3, k, None if k % 7 == 0 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, t int, k int, v double")
    for keys in (["g"], []):
        for before in (False, True):
            got = {r["k"]: r["s"] for r in running(df, keys, ["t", "k"], {"s": F.col("v")}, before, piece).collect()}
            for g, t, k, _ in rows:
                past = [v for h, u, j, v in rows if (not keys or h == g) and ((u, j) < (t, k) if before else (u, j) <= (t, k)) and v is not None]
                assert got[k] == (sum(past) if past else None)
