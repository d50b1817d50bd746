import os

import pytest
from pyspark.sql import functions as F

from tidegrid import report
from tidegrid.__main__ import main
from tidegrid.sources import records
from tidegrid.streaming import replay

T = "instrument string, seq long, ts_event long, action int, bid_px_0 long, ask_px_0 long, bid_sz_0 long, ask_sz_0 long"
S = 10**9


def ticks(spark):
    rows = [(i, k, k * S // 3, 3 if k % 2 else 2, None if k % 5 == 4 else 100 + k % 3, 101 + k % 3 + k % 4, k % 7, k % 3) for i in ("A", "B") for k in range(40)]
    return spark.createDataFrame(rows, T)


def ctx(spark):
    return spark.createDataFrame([("A", 4.0, 100.5), ("B", None, None)], "instrument string, base_depth double, pre_mid double")


def key(r):
    return tuple(r[c] for c in ("instrument", "seq", "ts_event", "spread", "depth", "depth_pct", "mid_move", "trades_1s", "updates"))


def test_stream_equals_batch(spark, tmp_path):
    t = ticks(spark)
    for k in range(2):  # two files, so two micro-batches
        t.filter((F.col("ts_event") < 5 * S) == (k == 0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(T).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    files = sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: spark.read.parquet(str(p)).agg(F.min("ts_event")).first()[0])
    for i, p in enumerate(files):
        os.utime(p, (1_000_000 + i, 1_000_000 + i))
    q = replay.live_states(stream, ctx(spark)).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {key(r) for r in spark.sql("select * from live").collect()}
    assert got == {key(r) for r in replay.states(t, ctx(spark), ["instrument"]).collect()}
    text = replay.exposition(spark.sql("select * from live where seq = 39").collect())
    assert 'replay_updates{instrument="A"} 40' in text


def test_alerts_and_rates(spark):
    s = replay.states(ticks(spark), ctx(spark), ["instrument"])
    kinds = {r["alert"] for r in replay.alerts(s, ["instrument"], 3, 25.0, 5).collect()}
    assert kinds == {"wide spread", "thin depth"}
    r = replay.update_rates(ticks(spark), ["instrument"], "5 seconds").agg(F.sum("updates")).first()[0]
    assert r == 80


def test_paced_source(spark, tmp_path):
    ticks(spark).coalesce(1).write.parquet(str(tmp_path / "t"))
    path = next(str(p) for p in (tmp_path / "t").glob("*.parquet"))
    with pytest.raises(ValueError):
        replay.PacedReader(ticks(spark).schema, {"path": path, "speed": "0"})
    reader = replay.PacedReader(ticks(spark).schema, {"path": path, "speed": "1e9"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert end == {"row": 80} and [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert list(reader.readBetweenOffsets({"row": 0}, {"row": 3})) == rows[:3]


def test_records(spark):
    df = spark.createDataFrame([(112_000_000_000,), (112_015_625_000,), (2**63 - 1,), (None,)], "p long")
    assert [r[0] for r in df.select(records.to_ticks(F.col("p"), F.lit(1 / 64))).collect()] == [7168, 7169, None, None]
    raw = spark.createDataFrame([(1, "T", "B", 10**9, 3, 10**9, 2 * 10**9, 5, 6), (2, "?", "?", 2**63 - 1, 3, 10**9, 2**63 - 1, 5, 6)], "ts_event long, action string, side string, price long, size int, bid_px_00 long, ask_px_00 long, bid_sz_00 int, ask_sz_00 int")
    got = records.book_frame(raw, F.lit(1.0), 1).orderBy("ts_event").collect()
    assert (got[0]["action"], got[0]["side"], got[0]["ask_px_0"]) == (3, 1, 2) and (got[1]["action"], got[1]["side"], got[1]["price"], got[1]["ask_px_0"]) == (2, 0, None, None)


def test_manifest_template_and_report(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        records.read_with_manifest(spark, path)
    spark.range(3).write.parquet(path)
    with pytest.raises(records.IncompleteTableError):
        records.read_with_manifest(spark, path)
    records.write_with_manifest(spark.range(5), path, {"why": "test"})
    assert records.read_with_manifest(spark, path).count() == 5
    assert records.template(str(tmp_path / "x.csv"), ["a", "b"]) and not records.template(str(tmp_path / "x.csv"), ["a"])
    page = tmp_path / "page.md"
    page.write_text(f"head\n{report.START}\nold\n{report.END}\ntail")
    report.replace_block(str(page), "new", False)
    assert "old" not in page.read_text() and "new" in page.read_text()
    with pytest.raises(ValueError):
        report.replace_block(str(page), "new", True)
    report.write_report(str(tmp_path / "r.md"), {"A": report.markdown_table(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double"))}, True)
    assert "| 1 | n/a | 0.50 |" in (tmp_path / "r.md").read_text() and "synthetic" in (tmp_path / "r.md").read_text()


def test_command_line(spark, data, tmp_path, capsys):
    assert main(["list"]) == 0 and "liquidity_curves" in capsys.readouterr().out
    assert main(["run", "nothing", data]) == 2 and main(["demo", "--events", "1"]) == 2
    assert main(["run", "group_labels", data, "--out", str(tmp_path / "o")]) == 0
    assert records.read_with_manifest(spark, str(tmp_path / "o")).count() > 0


def test_study_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    """Synthetic books to panels, all analyses, report and replay; and what is refused."""
    monkeypatch.setattr("tidegrid.sources.provider.MADE_UP", [("ZN", 2.0, 7168, 900.0, 0.15, 0.05, -4.0, 0), ("ZT", 2.0, 6600, 1200.0, 0.15, 0.03, -2.0, 2)])
    data = ["--data", str(tmp_path / "d"), "--set", "reps=20"]
    assert main([*data, "analyze", "liquidity"]) == 2
    assert main([*data, "synth", "--events", "3", "--controls", "2", "--fomc", "1"]) == 0
    assert main([*data, "analyze", "liquidity"]) == 2  # no panels yet
    assert main([*data, "panel", "build"]) == 0 and "events are confirmed" in capsys.readouterr().out
    assert main([*data, "analyze", "all"]) == 0
    out = capsys.readouterr().out
    assert "depth falls to a median" in out and "moves first" in out and "tests survive" in out and "more than normal" in out
    assert main([*data, "report", "--out", str(tmp_path / "r.md")]) == 0
    text = (tmp_path / "r.md").read_text()
    assert all(f"## {n}" in text for n in ("Liquidity", "Reaction", "Regression", "Execution", "Strategy", "Validation")) and "synthetic" in text
    assert main([*data, "replay", "--fast", "--start", "-20", "--end", "20", "--metrics", str(tmp_path / "m")]) == 0
    assert "replay_updates_total" in (tmp_path / "m").read_text() and main([*data, "replay", "--speed", "0"]) == 2 == main([*data, "replay", "--window", "none"])
    assert main(["--set", "nope=1", *data, "panel", "build"]) == 2


def test_calendar_and_costs_from_the_command_line(spark, tmp_path, capsys):
    d = tmp_path / "d"
    data = ["--data", str(d)]
    assert main([*data, "calendar", "validate"]) == 0 and main([*data, "calendar", "template"]) == 0
    (d / "meetings.csv").write_text("date,statement_time_et,press_conference_time_et,source_url\n2024-05-01,14:00,14:30,https://x.y\n2024-05-04,2 pm,,no\n")
    assert main([*data, "calendar", "validate"]) == 1 and "weekend" in capsys.readouterr().out
    (d / "meetings.csv").write_text("date,statement_time_et,press_conference_time_et,source_url\n2024-05-01,14:00,14:30,https://x.y\n")
    (d / "releases.csv").write_text("event_type,tier,date,time_et,source\nCPI,1,2024-05-15,08:30,s\nCPI,1,2024-06-12,08:30,s\n")
    assert main([*data, "calendar", "build"]) == 0
    assert main([*data, "data", "controls", "08:30=4", "--first", "2024-05-01", "--last", "2024-06-30"]) == 2  # no second tier
    (d / "releases.csv").write_text((d / "releases.csv").read_text() + "PPI,2,2024-05-14,08:30,s\n")
    assert main([*data, "calendar", "build"]) == 0 and main([*data, "data", "controls", "08:30=4", "--first", "2024-05-01", "--last", "2024-06-30"]) == 0
    assert spark.read.option("header", True).csv(str(d / "controls.csv")).count() == 4
    (d / "quotes.csv").write_text("instrument,feed_schema,window_id,seconds,cost_usd\nZN,mbp-1,CPI_2024-05-15,100,1\nZN,mbp-1,CPI_2024-06-12,300,2\nES,mbp-1,CPI_2024-05-15,100,2\n")
    (d / "instruments.csv").write_text("instrument,deep,core\nZN,true,true\nES,false,false\n")
    (d / "schemas.csv").write_text("feed_schema,lo_s,hi_s,short_lo_s,short_hi_s,deep\nmbp-1,-100,100,-50,50,false\n")
    capsys.readouterr()
    assert main([*data, "data", "plan-costs", "--budget", "20", "--fewer", "2"]) == 0
    # 3 events and 4 controls of 200 s (the meeting 1,800 s more), ZN at 3 / 400 USD a second, ES at twice that.
    out = capsys.readouterr().out
    assert f"| full plan | {3 * 0.0075 * (7 * 200 + 1800):.2f} |" in out and f"| all three trims | {0.0075 * (5 * 100 + 1800):.2f} | True |" in out
    assert main([*data, "data", "download", "--budget", "20"]) == 0 and "dry run" in capsys.readouterr().out
    assert main([*data, "data", "download", "--budget", "20", "--yes"]) == 0 and main([*data, "data", "download", "--budget", "20"]) == 0
    assert "cached" in capsys.readouterr().out


def test_binary_records(spark, tmp_path):
    import numpy as np
    import zstandard

    from tidegrid.sources import dbn

    def rows(kind, n, price):
        out = np.zeros(n, np.dtype(dbn.KINDS[kind][1]))
        out["length"], out["rtype"], out["ts_event"], out["instrument_id"] = out.dtype.itemsize // 4, dbn.KINDS[kind][0], np.arange(n) + 10**18, 7
        if kind != "ohlcv-1s":
            out["action"], out["side"], out["price"], out["size"], out["sequence"], out["bid_px_00"], out["ask_px_00"] = b"T", b"B", price, 3, np.arange(n), price, 2**63 - 1
        return out

    head = b"DBN\x02" + (4).to_bytes(4, "little") + b"meta"
    assert np.dtype(dbn.KINDS["mbp-1"][1]).itemsize == 80 and np.dtype(dbn.KINDS["mbp-10"][1]).itemsize == 368 and np.dtype(dbn.KINDS["ohlcv-1s"][1]).itemsize == 56
    (tmp_path / "a.dbn").write_bytes(head + rows("mbp-10", 5, 112 * 10**9).tobytes())
    mixed = rows("mbp-10", 2, 10**9).tobytes() + rows("ohlcv-1s", 3, 0).tobytes() + rows("mbp-10", 1, 10**9).tobytes()
    (tmp_path / "b.dbn.zst").write_bytes(zstandard.compress(head + mixed))
    dbn.register(spark)
    got = spark.read.format("dbn").option("kind", "mbp-10").load(str(tmp_path))
    assert got.groupBy("file").count().orderBy("file").collect() == [("a.dbn", 5), ("b.dbn.zst", 3)]
    book = records.book_frame(got.filter("file = 'a.dbn'"), F.lit(1 / 64), 10).first()
    assert (book["price"], book["bid_px_0"], book["ask_px_0"], book["action"], book["side"], book["size"]) == (7168, 7168, None, 3, 1, 3)
    assert spark.read.format("dbn").option("kind", "ohlcv-1s").load(str(tmp_path / "b.dbn.zst")).count() == 3
    with pytest.raises(ValueError):
        dbn.records_of(head + rows("mbp-1", 1, 1).tobytes()[:-5], "mbp-1")
    with pytest.raises(ValueError):
        dbn.records_of(b"something else", "mbp-1")


def test_vintages_and_hidden_keys(spark):
    from tidegrid.sources import releases

    found = [{"realtime_start": "2024-10-10", "date": "2024-09-01", "value": "100.3"}, {"realtime_start": "2024-11-13", "date": "2024-10-01", "value": "."}]
    d = releases.vintages(spark, lambda endpoint, p: {"count": 2, "observations": found[p["offset"] : p["offset"] + 1]}, "S")
    assert [r["value"] for r in d.orderBy("date").collect()] == [100.3, None]
    with pytest.raises(releases.ServiceError) as e:
        releases.http("http://127.0.0.1:9/none", "secret", 1.0)("releases", {})
    assert "secret" not in str(e.value) and "releases" in str(e.value)


def test_only_sound_windows_and_agreed_ticks_pass(spark):
    from tidegrid.sources import provider

    s, t0 = 10**9, 10**18
    rows = [(w, "ZN", k, t0 + (k - 60) * s, 2, 1, 102 if w == "bad" and k == 5 else 100, 101, 1, 1) for w in ("good", "bad") for k in range(180)]
    ticks = spark.createDataFrame(rows, "window_id string, instrument string, seq long, ts_event long, action int, size long, bid_px_0 long, ask_px_0 long, bid_sz_0 long, ask_sz_0 long")
    stages = spark.createDataFrame([("good", t0), ("bad", t0)], "window_id string, t0_ns long")
    out = provider.gate(provider.Books(ticks, stages), 60, 120)
    assert {r["window_id"] for r in out.ticks.select("window_id").distinct().collect()} == {"good"}
    assert {(r["window_id"], r["status"]) for r in out.report.collect()} == {("good", "ok"), ("bad", "reject")}
    d = spark.createDataFrame([("ZN", 1 / 64)], "instrument string, tick_size double")
    provider.check_tick_sizes(d, {"ZN": 1 / 64})
    with pytest.raises(ValueError, match="ZN"):
        provider.check_tick_sizes(d, {"ZN": 1 / 32})


def test_entry(spark, data):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and e.entry(spark).limit(1).count() == 1
