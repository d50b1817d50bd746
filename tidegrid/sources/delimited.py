"""Delimited text lines into typed rows, the unusable lines kept apart with a reason.

Structural indexing: over the bytes of a whole Arrow batch a mask of the quote marks and its prefix parity tell which commas
stand outside quotes; from these the fields follow, and their count, quoting and types are judged for all lines at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[ \t]*[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?[ \t]*$"
WEB = r"^https?://[^\s\pZ/?#:@]+(:[0-9]+)?([/?#][^\s\pZ]*)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


@dataclass(frozen=True)
class Field:
    """A column of the file: "text", "number" or "web"; only a `judged` field can make its line unusable."""

    name: str
    kind: str = "text"
    judged: bool = False


#: The columns of a file of surprises.
SURPRISE_FIELDS = (
    Field("event_id"), Field("event_type"), Field("release_date", "date"), Field("variable"), Field("actual", "number", True),
    Field("consensus", "number", True), Field("prior", "number"), Field("unit"), Field("source_url", "web", True), Field("notes"),
)


def record_ends(data: np.ndarray, quote: int = 34, end: int = 10) -> np.ndarray:
    """Positions of the line feeds that end a record, those outside quotes, in the bytes of a file."""
    outside = (np.cumsum(data == quote) & 1) == 0
    return np.flatnonzero((data == end) & outside)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array."""
    size = ends - starts
    to = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def parse_lines(lines: pa.Array, fields: tuple[Field, ...], comma: int = 44, quote: int = 34) -> tuple[pa.Array, list[pa.Array]]:
    """Reason per line (NULL: sound) and the fields as unquoted text, NULL where the line is unusable.

    Reasons, the first that holds: "no line" (NULL), "empty line", "column count", "broken quoting", "invalid <field>".
    """
    lines = lines.cast(pa.large_string())
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    lines = pa.concat_arrays([lines])  # offsets from 0
    n = len(lines)
    width = len(fields)
    if not n:
        return pa.array([], pa.string()), [pa.array([], pa.large_string())] * width
    to = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[to[0] : to[-1]]
    to = to - to[0]
    marks = data == quote
    quotes = np.concatenate(([0], np.cumsum(marks)))  # before each byte
    start_quotes = np.repeat(quotes[to[:-1]], np.diff(to))
    inside = ((quotes[:-1] - start_quotes) & 1).astype(bool)
    cuts = np.flatnonzero((data == comma) & ~inside)
    line_of_cut = np.searchsorted(to, cuts, side="right") - 1
    count = np.bincount(line_of_cut, minlength=n) + 1

    # All fields of all lines in order: each begins after a cut or at the start of its line.
    starts = np.concatenate((to[:-1], cuts + 1))
    ends = np.concatenate((to[1:], cuts))
    line_of_start = np.concatenate((np.arange(n), line_of_cut))
    line_of_end = line_of_start
    starts = starts[np.lexsort((starts, line_of_start))]
    ends = ends[np.lexsort((ends, line_of_end))]
    line = np.sort(line_of_start, kind="stable")

    # Quoting: no mark at all, or one at each end and every other one doubled.
    has = quotes[ends] > quotes[starts]
    at_ends = np.zeros(len(starts), bool)
    long = np.flatnonzero(has & (ends - starts >= 2))
    at_ends[long] = marks[starts[long]] & marks[ends[long] - 1]
    even = ((quotes[ends] - quotes[starts]) & 1) == 0
    closes = np.flatnonzero(marks & inside)  # marks at which the parity goes back to even
    follows = np.concatenate((marks[1:], [False]))
    field_end = ends[np.searchsorted(starts, closes, side="right") - 1] if len(closes) else closes
    single = closes[(closes + 1 < field_end) & ~follows[closes]]
    lone = np.bincount(np.searchsorted(starts, single, side="right") - 1, minlength=len(starts)) > 0 if len(single) else np.zeros(len(starts), bool)
    broken = has & ~(at_ends & even & ~lone)
    broken_line = np.bincount(line[broken], minlength=n) > 0

    null = pc.is_null(lines).to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.utf8_trim_whitespace(pc.fill_null(lines, "")), "").to_numpy(zero_copy_only=False)
    reason = np.full(n, None, object)
    reason[count != width] = "column count"
    # A stray mark swallows commas: then the quoting is what is wrong.
    reason[broken_line] = "broken quoting"
    reason[empty] = "empty line"
    reason[null] = "no line"
    good = np.flatnonzero(count == width)
    first = np.searchsorted(line, good)
    out = []
    for k, f in enumerate(fields):
        s, e, h = starts[first + k], ends[first + k], has[first + k] & ~broken[first + k]
        text = _gather(data, s + h, e - h)
        text = pc.if_else(pa.array(h), pc.replace_substring(text, '""', '"'), text)
        if f.judged:
            ok = pc.match_substring_regex(text, NUMBER if f.kind == "number" else WEB).to_numpy(zero_copy_only=False)
            bad = good[~ok]
            reason[bad] = np.where([r is None for r in reason[bad]], f"invalid {f.name}", reason[bad])
        out.append(text)
    where = np.full(n, -1)
    where[good] = np.arange(len(good))
    sound = np.array([r is None for r in reason])
    take = pa.array(np.where(sound, where, -1), pa.int64(), mask=~sound)
    return pa.array(reason, pa.string()), [t.take(take) for t in out]


def load_lines(df: DataFrame, line: str, fields: tuple[Field, ...] = SURPRISE_FIELDS, keep: tuple[str, ...] = (), header: str | None = None) -> DataFrame:
    """`keep`, then the typed fields, then reason (NULL for a sound line), one row for each row of `df`.

    header: a column holding the line's number in its file; line 1 is left out. Numbers may carry blanks around them, a sign
    and commas between groups of three; a field that isn't judged becomes NULL where it doesn't fit its type. Defined cases:
    NULL, empty and very long lines, and a NULL line number (no header); repeated rows stay; other columns are not read.
    """
    if header:
        df = df.filter(F.col(header).isNull() | (F.col(header) != 1))
    kept = df.select(*keep, F.col(line).alias("__line"))
    text = [f"__f{i}" for i in range(len(fields))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "reason string", *(f"{t} string" for t in text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reason, columns = parse_lines(b.column(len(keep)), fields)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], reason, *[c.cast(pa.string()) for c in columns]], names=[*keep, "reason", *text])

    rows = kept.mapInArrow(run, schema)
    typed = []
    for f, t in zip(fields, text):
        c = F.col(t)
        if f.kind == "number":
            c = F.when(c.rlike(NUMBER), F.regexp_replace(F.trim(F.translate(c, "\t", " ")), ",", "")).try_cast("double")
        elif f.kind == "date":
            c = F.when(c.rlike(DATE), c).try_cast("date")
        typed.append(c.alias(f.name))
    return rows.select(*keep, *typed, "reason")
