import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidegrid.operators.counter_grid import Grid, counter_to_grid, last_readings, missing_points, read_grids

G = [Grid("fine", -10, 30, 2, 6), Grid("odd", -7, 200, 3, 7)]


def brute(rows):
    out, series = set(), {}
    for k, o in rows:
        series.setdefault(k, []).append(o)
    for k, offs in series.items():
        for g in G:
            for p in range(g.start, g.end + 1, g.step):
                if not any(o is not None and p - g.reach < o <= p for o in offs):
                    out.add((k, g.name, p))
    return out


@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-30, 220))), max_size=30))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_missing_points(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, o long, grid_name string")
    got = {(r["k"], r["grid_name"], r["offset"]) for r in missing_points(df, ["k"], "o", G).collect()}
    assert got == brute(rows)
    points = last_readings(df, ["k"], "o", ["o"], ["o"], G).collect()
    assert {(r["k"], r["grid_name"], r["offset"]) for r in points if r["missing"]} == got
    assert len(points) == len({k for k, _ in rows}) * sum(g.points for g in G)
    for r in points:
        if not r["missing"]:
            assert r["o"] == max(o for k, o in rows if k == r["k"] and o is not None and o <= r["offset"])


def test_grid_column_and_no_grid(spark):
    df = spark.createDataFrame([("a", 0, "fine"), ("a", 5, None), ("a", 5, "none")], "k string, o long, g string")
    assert {r["grid_name"] for r in missing_points(df, ["k"], "o", G, "g").collect()} == {"fine"}
    assert missing_points(df, ["k"], "o", []).count() == 0
    params = spark.createDataFrame([("b", 1, 0, 4, 2), ("a", 1, 0, 4, 2), ("b", 1, 0, 4, 2), (None, 1, 0, 4, 2)], "grid_name string, step_ms long, start_ms long, end_ms long, max_age_ms long")
    assert [g.name for g in read_grids(params, 1)] == ["a", "b"]


def test_counter_with_reset_and_silence(spark):
    rows = [("a", 0, 10.0), ("a", 10, 20.0), ("a", 10, 15.0), ("a", 20, 4.0), ("a", 60, 44.0), ("a", None, 3.0), ("b", 5, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {r["offset"]: (r["growth"], r["resets"], r["covered"]) for r in counter_to_grid(df, ["k"], "t", "v", Grid("g", 0, 60, 10, 20)).collect()}
    assert got == {10: (10.0, 0, 1.0), 20: (4.0, 1, 1.0), 30: (None, 0, 0.0), 40: (None, 0, 0.0), 50: (None, 0, 0.0), 60: (None, 0, 0.0)}


def test_counter_is_kept_across_cuts(spark):
    r = random.Random(2)
    rows = [("h", t, float(v)) for t, v in zip(sorted(r.sample(range(1000), 200)), range(0, 2000, 10))] + [("c", 3, 1.0), ("c", 9, 2.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    g = Grid("g", 0, 1000, 50, 10**6)
    a, b = ({(x["k"], x["offset"]): round(x["growth"], 9) for x in counter_to_grid(df, ["k"], "t", "v", g, n).collect()} for n in (500_000, 20))
    assert a == b and abs(sum(v for k, v in a.items() if k[0] == "h") - 1990) < 1e-6
