import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.orphans import orphan_periods, parent_changes, probe
from tidegrid.streaming.orphans import IncrementalOrphans


def day(k):
    return None if k is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def answered(parents, key, t):
    return t is not None and any(p[0] == key and p[1] is not None and p[1] <= t and (p[2] is None or p[2] > t) for p in parents)


@pytest.mark.parametrize("least", [10, 500_000])
def test_probe_against_brute_force(spark, least):
    r = random.Random(3)
    keys = ["hot"] * 6 + ["b", "c", None]
    parents = [(r.choice(keys), r.choice([None, *range(40)]), r.choice([None, None, *range(40)])) for _ in range(60)]
    refs = [(i, r.choice(keys), r.choice([None, *range(40)])) for i in range(120)]
    p = spark.createDataFrame([(k, day(a), day(b), "x") for k, a, b in parents] * 2, "k string, a timestamp, d timestamp, id string")
    q = spark.createDataFrame([(i, k, day(t), 1) for i, k, t in refs + refs[:9]], "id long, k string, t timestamp, change int")
    got = {x["id"]: x["answered"] for x in probe(q, p, "id", ["k"], "t", ["k"], "a", "d", least).collect()}
    assert got == {i: answered(parents, k, t) for i, k, t in refs if k is not None}


def test_empty_tables_and_periods(spark):
    p = spark.createDataFrame([], "k string, a timestamp, d timestamp")
    q = spark.createDataFrame([(1, "x", day(3)), (2, "x", day(40)), (3, None, day(1))], "id long, k string, t timestamp")
    out = probe(q, p, "id", ["k"], "t", ["k"], "a", "d").withColumn("f", F.lit("k"))
    assert {(r["id"], r["answered"], r["resolved_us"]) for r in out.collect()} == {(1, False, None), (2, False, None)}
    assert {(str(r["period"]), r["orphans"]) for r in orphan_periods(out, "f", "entered_us").collect()} == {("2024-01-01", 1), ("2024-02-01", 1)}
    assert probe(q.limit(0), p, "id", ["k"], "t", ["k"], "a", "d").count() == 0


PARENTS = [("a", 5, 15), ("a", 12, None), ("b", 3, 6), ("c", 20, None), ("e", 1, 11), ("e", 13, None)]
REFS = [(1, "a", 4), (2, "a", 5), (3, "b", 4), (4, "b", 7), (5, "c", 1), (6, "d", 9), (7, "a", 16), (8, "e", 2), (9, "d", None)]


def history(spark):
    p = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in PARENTS], "k string, a timestamp, d timestamp")
    q = spark.createDataFrame([(i, k, day(t)) for i, k, t in REFS], "id long, k0 string, at timestamp").withColumn("t", F.unix_micros("at"))
    return p, q, parent_changes(p, ["k"], "a", "d")


@pytest.mark.parametrize("piece", [4, 500_000])
def test_batches_give_the_same_as_the_whole(spark, tmp_path, piece):
    p, q, changes = history(spark)
    events, state = [], None
    for lo, hi in ((-1, 5), (5, 10), (10, 99)):
        state = IncrementalOrphans(spark, str(tmp_path), ["k0"], buckets=3, piece=piece)  # each batch starts from what is written
        span = (F.col("t") > F.unix_micros(F.lit(day(lo)))) & (F.col("t") <= F.unix_micros(F.lit(day(hi))))
        events += [(r["id"], r["event"]) for r in state.step(q.filter(span | (F.col("t").isNull() if lo < 0 else F.lit(False))), changes.filter(span)).collect()]
    whole = probe(q, p, "id", ["k0"], "at", ["k"], "a", "d")
    assert {i for i, e in events if e == "orphaned"} == {r["id"] for r in whole.filter("not answered").collect()} == {1, 4, 5, 6, 9}
    assert sorted(e for e in events if e[1] != "orphaned") == [(1, "resolved"), (3, "reopened"), (5, "resolved"), (8, "reopened"), (8, "resolved")]
    assert {r["answered"]: r["references"] for r in state.snapshot().collect()} == {True: 5, False: 4}


def test_replay_by_period(spark, tmp_path):
    _, q, changes = history(spark)
    events = IncrementalOrphans(spark, str(tmp_path), ["k0"]).replay(q, changes, "week")
    assert {r["id"] for r in events.filter("event = 'orphaned'").collect()} == {1, 4, 5, 6, 9}
    assert {(r["id"], r["t"]) for r in events.filter("event = 'resolved'").select("id", F.dayofyear(F.timestamp_micros("t")).alias("t")).collect()} == {(1, 6), (5, 21), (8, 14)}


def test_an_interrupted_batch_is_done_again(spark, tmp_path):
    _, q, changes = history(spark)
    first = IncrementalOrphans(spark, str(tmp_path), ["k0"])
    before = dict(first.state)
    a = sorted(map(tuple, first.step(q, changes).collect()))
    first.state = before
    (tmp_path / "current.json").unlink()
    assert sorted(map(tuple, IncrementalOrphans(spark, str(tmp_path), ["k0"]).step(q, changes).collect())) == a


def test_a_step_does_not_read_the_answered_history(spark, tmp_path):
    """Answered references pile up; a batch without deletions reads none of them."""
    state = IncrementalOrphans(spark, str(tmp_path), ["k0"], buckets=2)
    parents = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k0 string, t long, change long")
    none, read = parents.limit(0), []
    for k in range(3):
        refs = spark.createDataFrame([(100 * k + i, "ab"[i % 2], 10 * k + 5) for i in range(50)], "id long, k0 string, t long")
        seen, inner = [], state._read
        state._read = lambda part, buckets, keys: (seen.append((part, inner(part, buckets, keys).count())), inner(part, buckets, keys))[1]
        state.step(refs, parents if k == 0 else none)
        state._read = inner
        read.append(dict(seen))
    assert read[1] == read[2] == {"index": 2, "waiting": 0, "answered": 0}
    assert state.snapshot().collect() == [(True, 150)]
