import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.config import GridSettings, Study, load, with_overrides
from tidegrid.operators import calendar, execution, liquidity, panel, quality, reaction, regression, stats, strategy
from tidegrid.sources import synthetic
from tidegrid.sources.releases import ServiceError, find_release, pages, release_dates, releases

PLANTED = Study(coarse=GridSettings(1000, -300, 600), fine=GridSettings(100, -60, 120), baseline_s=(-300, -100), curve_s=(-100, 300), reps=50, hold=10)


@pytest.fixture(scope="module")
def planted(spark):
    stages = synthetic.study_calendar(spark, 3, 2)
    inst = spark.createDataFrame([("ZN", 6.0, 7168, 900.0, 0.15, 0.05, -4.0, 0), ("ES", 6.0, 26000, 400.0, 0.15, 0.05, -8.0, 12)], "instrument string, rate double, start_price long, base_depth double, trade_share double, vol double, jump double, lag_ms int")
    ticks = synthetic.books(spark, stages, inst, -300, 600).cache()
    coarse = panel.panel(ticks, stages, PLANTED.coarse.grid("c")).cache()
    return stages, ticks, coarse, liquidity.with_baselines(coarse, panel.baselines(coarse, PLANTED.baseline_s)).cache()


def test_planted_liquidity(spark, planted):
    liq = planted[3]
    m = liquidity.event_metrics(liq, PLANTED).join(liquidity.withdrawal_starts(liq, PLANTED), liquidity.SERIES).filter("instrument = 'ZN'").toPandas()
    ev, ctl = m[~m.group.str.startswith("CONTROL")], m[m.group.str.startswith("CONTROL")]
    assert abs(ev.withdrawal_start_s.astype(float).median() + 20) <= 6
    assert abs(ev.min_depth_pct.median() - 20) <= 8
    assert abs(ev.recovery_50_s.median() - 20.3) <= 6 and abs(ev.recovery_90_s.median() - 90) <= 20
    assert ctl.min_depth_pct.min() > 60 and ctl.withdrawal_start_s.isna().all()


def test_planted_reaction(spark, planted):
    stages, ticks, coarse, _ = planted
    moves = panel.mid_changes(ticks, stages, (-60, 120))
    fine = panel.panel(ticks, stages, PLANTED.fine.grid("f"))
    first = reaction.first_moves(moves, reaction.thresholds(fine, 0.99)).toPandas()
    assert len(first) == 12 and (first.first_move_ms.dropna() >= 0).all()
    jumps = reaction.jump_sizes(coarse, Study(horizons_s=(1, 60, 7200), baseline_s=(-300, -100))).filter("event_type <> 'CONTROL'").toPandas()
    assert set(jumps.horizon_s) == {1, 60}


def test_ols_hc3_matches_matrix_form(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=60)
    y = 2 - 3 * x + r.normal(size=60) * (1 + np.abs(x))
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 1.0, 4.0), ("few", 1.0, 2.0), (None, 1.0, 1.0)]
    got = {k["g"]: k for k in stats.ols_hc3(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    X = np.column_stack([np.ones(60), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e, h = y - X @ b, np.einsum("ij,jk,ik->i", X, inv, X)
    se = math.sqrt((inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv)[1, 1])
    assert got["a"]["n_events"] == 60 and math.isclose(got["a"]["beta"], b[1], rel_tol=1e-9) and math.isclose(got["a"]["se_hc3"], se, rel_tol=1e-9)
    assert all(got[k]["beta"] is None for k in ("flat", "few", None)) and got["few"]["n_events"] == 1


def test_one_nonzero_regressor_has_no_error(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("a", 0.0, 3.0), ("a", 5.0, 9.0)], "g string, x double, y double")
    r = stats.ols_hc3(df, ["g"], "x", "y").first()
    assert r["beta"] is not None and r["se_hc3"] is None and r["t"] is None


def test_false_discovery_by_hand(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, None]
    out = stats.benjamini_hochberg(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p", 0.05).toPandas().set_index("i")
    assert out.survives_fdr.to_dict() == {i: i < 2 for i in range(9)} and pd.isna(out.q_bh[8])


def test_resampling_of_events():
    assert stats.interval(np.array([5.0]), 100, 1, "median") == (5.0, None, None, 1)
    est, lo, hi, n = stats.interval(np.array([5.0, 7.0, np.nan]), 200, 1, "mean")
    assert (est, lo, hi, n) == (6.0, 5.0, 7.0, 2)


def test_curves_resample_events_not_seconds(spark):
    rows = [("g", e, t, v) for e, v in (("a", 5.0), ("b", 7.0)) for t in range(20)] + [("one", "a", 0, 1.0)]
    out = stats.curve_intervals(spark.createDataFrame(rows, "g string, e string, t int, v double"), ["g"], "e", "t", "v", 200, 3).toPandas()
    two = out[out.g == "g"]
    assert (two["mean"] == 6).all() and (two.lo == 5).all() and (two.hi == 7).all() and out[out.g == "one"].lo.isna().all()


def test_book_walk(spark):
    px, sz = [101, 102, 103], [5, 10, 20]
    df = spark.createDataFrame([(1, 20), (10, 20), (25, 20), (25, 0)], "q int, last int")
    price, short = execution.walk([F.lit(p) for p in px], [F.lit(5), F.lit(10), F.col("last")], F.col("q"))
    got = [(r[0], r[1]) for r in df.select(price, short).collect()]
    assert got == [(101.0, False), (101.5, False), ((5 * 101 + 10 * 102 + 10 * 103) / 25, False), (None, True)]
    del sz


def test_pnl_and_causal_decisions(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "d double")
    assert [r[0] for r in df.select(strategy.pnl(F.col("d"), F.lit(100), F.lit(101), F.lit(104), F.lit(105))).collect()] == [3, -5, 0]
    r = np.random.default_rng(2)
    s = r.normal(size=30)
    ret = -3 * s + r.normal(size=30) * 0.1
    whole = decisions(spark, s, ret)
    assert all(d[2] == 0 for d in whole[:8]) and {d[0] for d in whole[10:]} == {-1.0}
    later = ret.copy()
    later[20:] = 99
    assert decisions(spark, s, later)[:21] == whole[:21]
    for k in range(8, 30):  # by hand: the mean signed return of the past beyond each threshold
        scale = np.std(s[:k], ddof=1)
        gains = [-np.mean(np.sign(s[:k][use]) * ret[:k][use]) if (use := abs(s[:k]) > th * scale).any() else -np.inf for th in (0.0, 0.5, 1.0)]
        best = (0.0, 0.5, 1.0)[int(np.argmax(np.array(gains) >= max(gains) - 1e-12))]
        assert whole[k][:2] == (-1.0, best) and whole[k][2] == (-np.sign(s[k]) if abs(s[k]) / scale > best else 0)


def decisions(spark, s, ret):
    t = spark.createDataFrame([("CPI", "ZN", 1, 2, k, float(a), float(b)) for k, (a, b) in enumerate(zip(s, ret))], "event_type string, instrument string, delay_s int, exit_s int, k long, surprise double, ret double")
    return [(r["sign_mapping"], r["threshold"], r["direction"]) for r in strategy.walk_forward(t, Study(least_training=8)).orderBy("k").collect()]


@given(st.lists(st.tuples(st.integers(-3, 5), st.integers(-9, 9), st.integers(0, 4)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_sums_above_against_brute_force(rows):
    size, worth, least = (np.array([float(r[i]) for r in rows]) for i in range(3))
    total, count = strategy.sums_above(size, worth, least)
    assert total.tolist() == [sum(w for a, w, _ in rows[:k] if a > c) for k, (_, _, c) in enumerate(rows)]
    assert count.tolist() == [sum(a > c for a, _, _ in rows[:k]) for k, (_, _, c) in enumerate(rows)]


def test_resampled_statistics_against_plain_ones():
    r = np.random.default_rng(5)
    x, y = r.integers(0, 4, 9).astype(float), r.normal(size=9)
    i, counts = stats.draws(9, 50, 3), stats.times_drawn(9, 50, 3)
    assert np.allclose(stats.resampled_medians(y, counts), np.median(y[i], axis=1))
    want = [np.polyfit(x[k], y[k], 1)[0] for k in i if len(set(x[k])) > 1]
    assert np.allclose(stats.resampled_slopes(x, y, counts), want)


def test_standardise(spark):
    rows = [(f"e{i}", "v", dt.date(2024, 1, i + 1), a, 0.0) for i, a in enumerate((0.1, 0.1, -0.1, 0.0))]
    df = spark.createDataFrame(rows, "event_id string, variable string, release_date date, actual double, consensus double")
    full = [r["z"] for r in regression.standardised(df).orderBy("event_id").collect()]
    assert np.allclose(full, np.array([0.1, 0.1, -0.1, 0]) / np.std([0.1, 0.1, -0.1, 0], ddof=1))
    assert [r["z"] for r in regression.standardised(df, True).orderBy("event_id").collect()] == [None, None, None, 0.0]


def test_quality_verdicts(spark):
    t0, s = 10**18, 10**9
    ticks = [("ok", k, t0 + (k - 60) * s, 2, 1, 100, 101, 1, 1) for k in range(180)]
    ticks += [("crossed", k, t0 + (k - 60) * s, 2, 1, 102 if k == 5 else 100, 101, 1, 1) for k in range(180)]
    ticks += [("gap", k, t0 + (k - 60) * s, 2, 1, 100, 101, 1, 1) for k in range(180) if not 50 < k < 91]
    ticks += [("twins", k, t0 + (k - 60) * s, 2, 1, 100, 101, 1, 1) for k in range(180) for _ in range(2 if k < 3 else 1)]
    df = spark.createDataFrame(ticks, "w string, seq long, ts_event long, action int, size long, bid_px_0 long, ask_px_0 long, bid_sz_0 long, ask_sz_0 long")
    win = spark.createDataFrame([(w, t0 - 60 * s, t0 + 120 * s, t0) for w in ("ok", "crossed", "gap", "twins", "empty")], "w string, start_ns long, end_ns long, t0_ns long")
    for least in (500_000, 50):
        v = {r["w"]: (r["status"], r["reasons"]) for r in quality.verdict(quality.check_windows(df, win, ["w"], piece=least)).collect()}
        assert {k: x[0] for k, x in v.items()} == {"ok": "ok", "crossed": "reject", "gap": "reject", "twins": "warn", "empty": "reject"}
        assert v["twins"][1] == ["3 duplicate records"] and v["empty"][1] == ["no data in the window"]


def test_clock_holidays_and_meetings(spark):
    from tidegrid.functions.clock import et_to_utc_ns

    cases = [("2025-03-07", "08:30", "13:30"), ("2025-03-10", "08:30", "12:30"), ("2025-10-29", "14:00", "18:00"), ("2025-11-05", "14:00", "19:00")]
    df = spark.createDataFrame(cases, "d string, t string, u string").withColumn("ns", et_to_utc_ns(F.to_date("d"), F.col("t")))
    for r in df.collect():
        assert dt.datetime.fromtimestamp(r["ns"] / 1e9, dt.UTC).strftime("%Y-%m-%d %H:%M") == f"{r['d']} {r['u']}"
    days = {d for d, _ in calendar.holidays(2024, 2026)}
    assert {dt.date(2026, 4, 3), dt.date(2026, 7, 3), dt.date(2026, 11, 26), dt.date(2026, 11, 27), dt.date(2026, 12, 24), dt.date(2024, 5, 27), dt.date(2025, 6, 19)} <= days
    assert len(days) == 36 and dt.date(2025, 10, 13) not in days
    assert [calendar.easter(y) for y in (1818, 1943, 2000, 2024, 2025, 2026, 2049, 2076)] == [dt.date(*d) for d in ((1818, 3, 22), (1943, 4, 25), (2000, 4, 23), (2024, 3, 31), (2025, 4, 20), (2026, 4, 5), (2049, 4, 18), (2076, 4, 19))]
    rows = [(1, "2024-05-01", "14:00", "14:30", "https://x.y"), (2, "2024-05-01", "14:00", "", "https://x.y"), (3, "2024-05-04", "2 pm", None, "no"), (4, "x", None, None, None), (5, "2024-05-02", "14:00", "13:00", "https://x.y")]
    f = calendar.meeting_faults(spark.createDataFrame(rows, "id int, date string, statement_time_et string, press_conference_time_et string, source_url string"), "id", "2024-01-01", "2024-12-31").collect()
    assert sorted((r["id"], r["fault"][:12]) for r in f) == [(2, "duplicate me"), (3, "source_url i"), (3, "statement_ti"), (3, "weekend"), (4, "date is not "), (5, "press confer")]


def test_duplicate_events_are_an_error(spark):
    rows = spark.createDataFrame([("CPI", 1, dt.date(2024, 5, 1), "release", "08:30", "s")] * 2, "event_type string, tier int, date date, stage string, time_et string, source string")
    with pytest.raises(Exception, match="duplicate events"):
        calendar.calendar(rows).collect()


def test_vintages(spark):
    d = dt.date
    v = spark.createDataFrame([("s", d(2024, 10, 10), d(2024, 8, 1), 100.0), ("s", d(2024, 10, 10), d(2024, 9, 1), 100.3), ("s", d(2024, 11, 13), d(2024, 9, 1), 100.25), ("s", d(2024, 11, 13), d(2024, 10, 1), 100.55)], "k string, realtime_start date, date date, value double")
    r = spark.createDataFrame([("s", d(2024, 11, 13)), ("s", d(2024, 11, 14))], "k string, release_date date")
    got = {x["release_date"].day: x for x in calendar.published_values(v, r, ["k"]).collect()}
    assert math.isclose(got[13]["change"], 0.3) and math.isclose(got[13]["pct_change"], (100.55 / 100.25 - 1) * 100) and got[13]["level"] == 100.55 and got[14]["level"] is None


def test_control_days_are_free_and_many_enough(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-31')) AS date")
    busy = spark.sql("SELECT '08:30' AS time_et, explode(sequence(DATE '2024-01-04', DATE '2024-03-28', INTERVAL 7 DAY)) AS date, 2 AS tier")
    wanted = spark.createDataFrame([("08:30", 20)], "time_et string, n int")
    out = calendar.control_days(days, busy, calendar.holiday_table(spark, 2024, 2024), busy, wanted, 1).toPandas()
    assert len(out) == 20 == out.date.nunique() and not any(d.weekday() in (3, 5, 6) for d in out.date)
    fewer = calendar.control_days(days, busy, calendar.holiday_table(spark, 2024, 2024), busy, wanted, 1, out_of := days.filter("date < DATE '2024-02-20'"))
    assert fewer.join(out_of, "date").count() == 0
    with pytest.raises(calendar.MissingTierError):
        calendar.control_days(days, busy.withColumn("tier", F.lit(1)), busy, busy, wanted, 1)


def test_settings():
    assert load(None, ["coarse.step_ms=500", "reps=10"]).coarse.step_ms == 500
    for bad in ({"nope": 1}, {"coarse.nope": 1}):
        with pytest.raises(KeyError):
            with_overrides(Study(), bad)
    with pytest.raises(TypeError):
        load(None, ['reps="x"'])


def test_release_service(spark):
    names = [{"id": 10, "name": "Consumer Price Index"}, {"id": 11, "name": "Consumer Price Index Extra"}, {"id": 12, "name": "Employment Situation"}]

    def fetch(endpoint, p):
        if endpoint == "releases":
            return {"count": 3, "releases": names[p["offset"] : p["offset"] + 2]}
        return {"count": 3, "release_dates": [{"date": x} for x in ("2024-01-11", "2024-01-11", "2030-01-01")][p["offset"] :]}

    t = releases(spark, fetch)
    assert find_release(t, "consumer price index ") == 10 and find_release(t, "employment") == 12
    with pytest.raises(LookupError):
        find_release(t, "price")
    assert [str(r["date"]) for r in release_dates(spark, fetch, 10, "2024-01-01", "2024-12-31").collect()] == ["2024-01-11"]

    def broken(endpoint, p):
        raise OSError("https://host/?key=secret")

    with pytest.raises(ServiceError) as e:
        pages(broken, "releases", "releases")
    assert "secret" not in str(e.value)
