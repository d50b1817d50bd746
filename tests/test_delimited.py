import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.sources.delimited import NUMBER, SURPRISE_FIELDS, load_lines, parse_lines, record_ends

F = '(?:"(?:[^"]|"")*"|[^",]*)'
LINE = re.compile(",".join([f"({F})"] * 10), re.S)
NUM, WEB = re.compile(NUMBER.replace("$", r"\Z")), re.compile(r"^https?://[^\s/?#:@]+(:[0-9]+)?([/?#]\S*)?\Z")


def sound(line):
    m = line is not None and LINE.fullmatch(line)
    if not m:
        return False
    f = [x[1:-1].replace('""', '"') if x.startswith('"') else x for x in m.groups()]
    return bool(NUM.match(f[4]) and NUM.match(f[5]) and WEB.match(f[8]))


piece = st.sampled_from(["a", "1.5", '"', '""', ",", '"x"', "", " ", "é", '"a,b"', "-2", "https://h.test/x", "1,204", '"1,204"'])


@given(st.lists(st.one_of(st.none(), st.lists(piece, max_size=26).map("".join)), max_size=12), st.lists(st.lists(piece, min_size=10, max_size=10).map(",".join), max_size=12))
@settings(max_examples=150, deadline=None)
def test_parse_lines_against_a_grammar(a, b):
    good = 'E,T,2024-01-02,"v, w",+1.5,"1,204",,u,https://h.test/a?b,"say ""x"""'
    lines = [*a, *b, good]
    reason, fields = parse_lines(pa.array(lines, pa.string()), SURPRISE_FIELDS)
    assert [r is None for r in reason.to_pylist()] == [sound(x) for x in lines]
    assert [f.to_pylist()[-1] for f in fields] == ["E", "T", "2024-01-02", "v, w", "+1.5", "1,204", "", "u", "https://h.test/a?b", 'say "x"']


def test_load_lines(spark):
    long = "x" * 100_000
    rows = [(1, 1, "event_id,..."), (2, 2, f"E,CPI,2024-01-02,v, 0.3 ,-1,200,u,http://h,{long}"), (3, 3, None), (4, 4, ""), (5, 5, 'E,T,D,v"w,1,2,3,u,http://h,n'), (6, 6, "E,T,D,v,x,2,3,u,http://h,n"), (7, None, "E,T,2024-02-30,v,1,2,?,u,http://h,n")]
    df = spark.createDataFrame(rows, "line_id long, no int, line string").withColumnRenamed("no", "line_no")
    got = {r["line_id"]: r for r in load_lines(df, "line", keep=("line_id",), header="line_no").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {2: None, 3: "no line", 4: "empty line", 5: "broken quoting", 6: "invalid actual", 7: None}
    assert (got[2]["actual"], got[2]["prior"], len(got[2]["notes"])) == (0.3, 200.0, 100_000) and got[7]["release_date"] is None and got[7]["prior"] is None
    assert load_lines(df.limit(0), "line", keep=("line_id",)).count() == 0


def test_record_ends():
    data = np.frombuffer(b'a,"x\ny"\nb\n', np.uint8)
    assert record_ends(data).tolist() == [7, 9]
