import csv

from tidegrid.operators.calendar import VARIABLES
from tidegrid.plans import problems, records

HEADER = "event_id,event_type,release_date,variable,actual,consensus,prior,unit,source_url,notes"
TAIL = "https://h.test/a"


def faults(spark, tmp_path, lines, known):
    rows = [(k, "f", k if k else None, x) for k, x in enumerate(lines, 1)] + [(99, "f", None, f"CPI_2024-01-11,CPI,2024-01-11,core_cpi_mom,0.3,0.2,,pct,{TAIL},no line number")]
    spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string").write.parquet(str(tmp_path / "surprise_lines.parquet"))
    spark.createDataFrame([(x,) for x in known], "event_id string").write.parquet(str(tmp_path / "stages.parquet"))
    return {(r["line_id"], r["fault"]) for r in records.QUERIES["validate_surprise_lines"](spark, str(tmp_path)).collect()}


def test_quoted_lines_are_judged(spark, tmp_path):
    lines = [
        HEADER,
        f'CPI_2024-01-11,CPI,2024-01-11,core_cpi_mom,0.3,0.2,,pct,{TAIL},"said ""firm"", then"',  # sound
        f"CPI_2024-01-11,CPI,2024-01-11,core_cpi_mom,0.3,0.2,,pct,{TAIL},",  # its earlier row is quoted
        f'NFP_2024-02-02,NFP,2024-02-02,nfp_change,"1,600",180,,thousands,{TAIL},a',  # above the range
        f'"NFP_2024-02-02",NFP,2024-02-02,unemployment_rate,3.7,3.8,,"percent","h.test","x, y"',
        f"NFP_2024-03-08,NFP,2024-03-08,ahe_mom,0.1,0.2,,pct,{TAIL},no such event",
        f'NFP_2024-02-02,NFP,"2 Feb, 2024",ahe_mom,0.1,0.2,,pct,{TAIL},',
        f'NFP_2024-02-02,NFP,2024-02-02,ahe"mom,0.1,0.2,,pct,{TAIL},',  # no ten fields
        None,
    ]
    assert faults(spark, tmp_path, lines, ["CPI_2024-01-11", "NFP_2024-02-02", None]) == {
        (3, "duplicate row"), (99, "duplicate row"), (4, "actual is outside the plausible range"), (5, "wrong unit"), (5, "source_url is not an http(s) link"),
        (6, "event is not in the calendar"), (7, "release_date is not YYYY-MM-DD"),
    }


def test_types_against_a_plain_reader(spark, data):
    """Faults that need one row only, against Python's csv on the test tables, over lines that both readers take alike."""
    lines = [r for r in spark.read.parquet(f"{data}/surprise_lines.parquet").collect() if r["line_no"] != 1 and r["line"]]
    usable = {r["line_id"] for r in lines} - {r["line_id"] for r in problems.queries()["p5_reasons"](spark, data).collect() if r["reason"] in ("column count", "broken quoting", "empty line", "no line")}
    known = {r["event_id"] for r in spark.read.parquet(f"{data}/stages.parquet").select("event_id").distinct().collect()}
    want = set()
    for r in lines:
        if r["line_id"] in usable:
            f = [x.strip(" ") for x in next(csv.reader([r["line"]]))]
            assert len(f) == 10
            if f[1] not in ("CPI", "NFP"):
                want.add((r["line_id"], "event_type must be CPI or NFP"))
            if f[3] not in VARIABLES:
                want.add((r["line_id"], "unknown variable"))
            elif VARIABLES[f[3]][0] != f[1]:
                want.add((r["line_id"], "variable of another event type"))
            if f[0] not in known:
                want.add((r["line_id"], "event is not in the calendar"))
    found = {(r["line_id"], r["fault"]) for r in records.QUERIES["validate_surprise_lines"](spark, data).collect()}
    undated = {k for k, f in found if f == "release_date is not YYYY-MM-DD"}
    names = {"event_type must be CPI or NFP", "unknown variable", "variable of another event type", "event is not in the calendar"}
    assert {x for x in found if x[1] in names} == {(k, f) for k, f in want if f != "event is not in the calendar" or k not in undated}
