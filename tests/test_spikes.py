import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql.types import ArrayType, MapType, StructType

from tidegrid.operators.spikes import NOISE, Reading, details, implausible_readings, threshold

SCHEMA = "id long, src string, at timestamp, n long, c long, g double, extra string"
READ = [Reading("c"), Reading("g", "span", 5400.0)]


def run(spark, rows, piece=500_000, dips=False):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "idle")
    out = implausible_readings(df, "id", ["src"], "at", READ, total="n", piece=piece)
    return {(r["id"], r["field_name"]): (r["impossible"], r["dip"] if dips else r["spike"], r["stuck"]) for r in out.collect()}


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def source(n, seed=1):
    r = random.Random(seed)
    return [[k, "a", at(k), 1000, r.choice([8, 9, 10, 11, 12]) + k % 2, 2.0 + r.random() / 5, "x"] for k in range(n)]


def test_spikes_bounds_and_runs(spark):
    rows = source(200)
    rows[50][4] = 300
    rows[60][5] = 90.0
    rows[61][5] = 95.0
    rows[70][4] = -1
    rows[71][4] = 1001
    rows[72][5] = 6000.0
    for k in range(100, 106):
        rows[k][5] = 2.125
    rows[103][5] = None  # not a reading: five are left
    for k in range(120, 127):
        rows[k][5] = 2.25
    rows[126][5] = None  # a check without a reading ends the run: six are left
    for k in range(140, 146):
        rows[k][5] = 2.375
    rows[143][3] = 0  # an empty window ends a run
    for k in range(160, 170):
        rows[k][5] = 0.0
    got = run(spark, rows + [rows[50]])
    assert {k for k, v in got.items() if v[1]} == {(50, "c"), (60, "g"), (61, "g")}
    assert {k for k, v in got.items() if v[0]} == {(70, "c"), (71, "c"), (72, "g")}
    assert {k[0] for k, v in got.items() if v[2] and k[1] == "g"} == {120, 121, 122, 123, 124, 125}


def brute_runs(rows, field):
    out, run = set(), []
    for r in sorted(rows, key=lambda r: (r[2], r[0])) + [[None, None, None, 0, None, None]]:
        v = r[field]
        if r[3] == 0 or v is None or (run and v != run[-1][1]):
            if len(run) >= 6 and run[0][1] != 0:
                out |= {i for i, _ in run}
            run = []
        if r[3] != 0 and v is not None:
            run.append((r[0], v))
    return out


@pytest.mark.parametrize("piece", [20, 60, 500_000])
def test_runs_across_cuts(spark, piece):
    r = random.Random(5)
    rows, v = [], 1
    for k in range(300):
        v = v if r.random() < 0.85 else r.choice([0, 1, 2, 3])
        rows.append([k, "hot" if k < 280 else "cold", at(k // 2), 0 if r.random() < 0.02 else 100, v if r.random() > 0.05 else None, None, ""])
    want = brute_runs([x for x in rows if x[1] == "hot"], 4) | brute_runs([x for x in rows if x[1] == "cold"], 4)
    got = run(spark, rows, piece)
    assert {k[0] for k, f in got.items() if f[2]} == want


@pytest.mark.parametrize("piece", [80, 120])
def test_spikes_across_cuts(spark, piece):
    r = random.Random(9)
    rows = source(300) + [[1000 + k, "cold", at(k), 1000, 10, 2.0, ""] for k in range(5)]
    for k in range(0, 300, 3):
        rows[k][4] = r.choice([10, 18, 22, 26, 30])
        rows[k][5] = r.choice([2.0, 2.4, 2.8, 3.2])
    for k in r.sample(range(300), 20):
        rows[k][r.choice([3, 4])] = r.choice([None, 0])
    rows[0][2] = rows[1][2] = None
    want = {k for k, v in run(spark, rows).items() if v[1]}
    assert len(want) >= 8 and {k for k, v in run(spark, rows, piece).items() if v[1]} == want


def test_dips_and_a_drifting_source(spark):
    """The details decide, not the level: a source that drifts far has no spike but the planted ones, and dips are found too."""
    r = random.Random(3)
    rows = [[k, "a", at(k), 10**6, round(400 + 3 * k + r.gauss(0, 8)), 2.0 + r.random() / 5, "x"] for k in range(400)]
    rows[90][4] -= 300
    rows[310][4] += 600
    rows[20][4] += 400  # still below the level of most of the source
    rows[200][5] = 0.3
    assert {k for k, v in run(spark, rows).items() if v[1]} == {(310, "c"), (20, "c")}
    assert {k for k, v in run(spark, rows, dips=True).items() if v[1]} == {(90, "c"), (200, "g")}


def test_details_by_hand():
    y = np.array([0.0] * 40 + [8.0] + [0.0] * 40)
    assert details(y)[40] == 8 and abs(details(y)).sum() == 8
    flat = np.arange(200.0)
    assert abs(details(flat)[50:150]).max() < 1e-9
    noise = np.random.default_rng(1).normal(size=200_000)
    assert abs(details(noise).std() - NOISE) < 0.02
    assert threshold(2_700, 0.01, 4.0) < threshold(27_000, 0.01, 4.0) < 5.1


def test_empty_and_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [[1, None, None, None, None, None, None], [2, None, None, None, 5, float("nan"), None]]) == {(2, "g"): (True, False, False)}


def test_rows_of_a_cut_table_carry_no_histograms(spark, monkeypatch):
    """With a cut anywhere, what goes to the pieces stays as narrow as without, for cut and whole sources, and so do the results."""
    r = random.Random(21)
    rows = source(600) + [[1000 + k, None, at(k // 2), 1000, r.choice([0, 9, 10, 11]), r.choice([None, 2.0, 2.1]), ""] for k in range(300)] + [[2000 + k, "cold", at(k), 1000, 10 + k % 3, 2.0, ""] for k in range(40)]
    for k, v in ((50, 300), (250, -1), (400, 1001), (450, 0), (2020, 300)):
        next(x for x in rows if x[0] == k)[4] = v
    given, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: (given.append(self._df.schema), real(self, *a))[1])
    df = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(map(tuple, implausible_readings(df, "id", ["src"], "at", READ, total="n", piece=p).collect())) for p in (500_000, 150)]
    assert got[0] == got[1] and {x[0] for x in got[0] if x[3]} == {50, 2020} and {x[0] for x in got[0] if x[4]} >= {450}
    assert given and not [f.name for s in given for f in s if isinstance(f.dataType, (ArrayType, MapType, StructType))]


def test_the_limit_of_a_cut_source_follows_its_spread(spark):
    """Readings that spread far wider than the least spread: cut or not, only what lies beyond the source's own spread is found."""
    r = random.Random(4)
    rows = [[k, "wide", at(k), 10**6, round((30 + r.gauss(0, 4)) ** 2), float(np.exp(r.gauss(0, 0.5))), ""] for k in range(900)]
    rows[300][5] = 400.0
    want = run(spark, rows)
    assert {k for k, v in want.items() if v[1]} == {(300, "g")}
    assert run(spark, rows, 150) == want and run(spark, rows, 150, dips=True) == run(spark, rows, dips=True)
