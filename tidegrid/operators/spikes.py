"""Implausible readings per source: spikes, stuck values and physically impossible values.

Method: the readings of a source, in order of time and on a variance-stabilising scale, pass through an undecimated wavelet
decomposition of five levels. What the details of a reading add up to (the reading less its smooth course) is scaled by its
robust spread over the source; a reading beyond the threshold is a spike. Runs of zero detail (equal neighbours) are stuck,
bounds give the impossible readings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.chunked import CHUNK, PIECE, assign_chunks, lookup
from tidegrid.functions.shared import cut, written

LEVELS = 5
#: Half the width of the running median that keeps spikes, and up to so many neighbours of one wrong value, out of the smooth course.
CLEAN = 16
#: Checks carried over a cut to each side: what the last level and the median see (47), and as many again for those without a reading.
REACH = 94
#: Spread of the summed details of white noise of unit variance over five levels: the root of 1 - 2 w(0) + sum of w^2 for the triangle of width 2^5.
NOISE = 0.979
#: Readings worked on at a time, for what a piece needs besides its rows.
BLOCK = 16_384
#: Classes a doubling in the histograms of the details' size, and their range as powers of two.
FINE, LOW, HIGH = 64, -10, 20


@dataclass(frozen=True)
class Reading:
    """A measured column. kind "count": a number of rows, at most the rows of the check; "span": a duration up to `most`."""

    column: str
    kind: str = "count"
    most: float | None = None


def stable(kind: str, x: np.ndarray) -> tuple[np.ndarray, float]:
    """A scale on which the usual readings spread alike, and the least spread on it: Anscombe's root for counts (the spread of
    a Poisson count is 1), the logarithm for durations (a twentieth)."""
    if kind == "count":
        return 2 * np.sqrt(x + 0.375), 1.0
    return np.log(np.maximum(x, 1e-6)), 0.05


def details(y: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """The summed details of each reading: the reading less the smooth of the last level.

    The smooth is that of the series cleaned by a running median, so that a spike stays out of its own and its neighbours'
    course. Beyond an end the series is continued by its own image, turned about the median of its last values, which keeps a
    drift; very short series by their end value.
    """
    n = len(y)
    if not n:
        return y
    if n > CLEAN:
        head, tail = 2 * np.median(y[:5]) - y[CLEAN:0:-1], 2 * np.median(y[-5:]) - y[-2 : -CLEAN - 2 : -1]
    else:
        head, tail = np.repeat(y[:1], CLEAN), np.repeat(y[-1:], CLEAN)
    padded, out, edge = np.concatenate((head, y, tail)), np.empty(n), 2**levels - 1
    for k in range(0, n, BLOCK):  # a block at a time, with what its smooth sees to each side
        lo, hi = max(k - edge, 0), min(k + BLOCK + edge, n)
        smooth = np.median(np.lib.stride_tricks.sliding_window_view(padded[lo : hi + 2 * CLEAN], 2 * CLEAN + 1), axis=1)
        at = np.arange(hi - lo)
        for j in range(levels):
            step = 2**j
            smooth = (smooth[np.maximum(at - step, 0)] + 2 * smooth + smooth[np.minimum(at + step, hi - lo - 1)]) / 4
        out[k : k + BLOCK] = y[k : k + BLOCK] - smooth[k - lo : k - lo + BLOCK]
    return out


def classes(size: np.ndarray) -> np.ndarray:
    """Class of a size; a class is about 1 % wide."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log2(size) * FINE), LOW * FINE, HIGH * FINE - 1).astype(np.int64) - LOW * FINE


def scale_of(histogram: np.ndarray, least: float) -> tuple[float, int]:
    """Robust spread from the histogram of sizes (the median of a normal variable's size is its spread over 1.4826), and the number of readings."""
    n = int(histogram.sum())
    if not n:
        return NOISE * least, 0
    middle = 2.0 ** ((np.searchsorted(np.cumsum(histogram), (n + 1) // 2) + 0.5) / FINE + LOW)
    return max(1.4826 * middle, NOISE * least), n


def threshold(n: int, false_alarms: float, floor: float) -> float:
    """The size that the largest of n normal details exceeds with the probability `false_alarms` (asymptotically), at least `floor`."""
    x = np.log(max(n, 2) / false_alarms)
    return max(floor, float(np.sqrt(2 * x - np.log(4 * np.pi * x))))


def _runs(held: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Length of the run of equal values each held reading belongs to; what isn't held ends a run."""
    if not len(v):
        return np.zeros(0, np.int64)
    new = np.ones(len(v), bool)
    new[1:] = ~(held[1:] & held[:-1] & (v[1:] == v[:-1]))
    of = np.cumsum(new)
    return np.bincount(of)[of]


class _Series:
    """One piece of a source in order, each check once."""

    def __init__(self, part: pa.Table):
        t = part.column("__t").to_numpy(zero_copy_only=False).astype(np.float64)
        ids = part.column("__id").combine_chunks()
        rank = np.asarray(ids.dictionary_encode().indices) if not pa.types.is_integer(ids.type) else ids.to_numpy(zero_copy_only=False)
        if not pa.types.is_integer(ids.type):  # order by value, not by first sight
            words = ids.dictionary_encode().dictionary.to_pylist()
            place = np.empty(len(words), np.int64)
            place[sorted(range(len(words)), key=lambda i: (words[i] is not None, words[i]))] = np.arange(len(words))
            rank = place[rank] if len(words) else rank
        order = np.lexsort((rank, np.where(np.isnan(t), -np.inf, t)))
        once = np.ones(len(order), bool)
        once[1:] = rank[order][1:] != rank[order][:-1]
        self.part, self.order = part, order[once]
        self.ids = ids.take(pa.array(self.order))
        self.own = ~np.asarray(part.column("__beyond"))[self.order]
        self.total = part.column("__total").to_numpy(zero_copy_only=False).astype(np.float64)[self.order]
        self.idle = self.total == 0

    def field(self, column: str, r: Reading) -> tuple[np.ndarray, ...]:
        """Of a field whether a check holds a reading, the readings, which are impossible, and the details (0 where there is no possible
        reading); with them the histogram of the sizes of the piece's own details. One field at a time, as a piece may be long."""
        x = self.part.column(column).combine_chunks()
        held = np.asarray(x.is_valid())[self.order] & ~self.idle
        v = x.to_numpy(zero_copy_only=False).astype(np.float64)[self.order]
        with np.errstate(invalid="ignore"):
            above = v > self.total if r.kind == "count" else v > (np.inf if r.most is None else r.most)
            wrong = held & (np.isnan(v) | (v < 0) | np.isinf(v) | above)
        possible = np.flatnonzero(held & ~wrong)
        d = np.zeros(len(v))
        d[possible] = details(stable(r.kind, v[possible])[0])
        own = possible[self.own[possible]]
        histogram = np.zeros((HIGH - LOW) * FINE, np.int64)
        for k in range(0, len(own), BLOCK):
            histogram += np.bincount(classes(np.abs(d[own[k : k + BLOCK]])), minlength=len(histogram))
        return held, v, wrong, d, histogram


def implausible_readings(
    df: DataFrame,
    row_id: str,
    source: list[str],
    time: str,
    readings: list[Reading],
    total: str | None = None,
    false_alarms: float = 0.01,
    floor: float = 4.0,
    run: int = 6,
    piece: int = PIECE,
) -> DataFrame:
    """One row (row_id, field_name, impossible, spike, dip, stuck) per implausible reading.

    impossible: negative, NaN, infinite, a count above `total`, a duration above its bound. spike (dip): a possible reading
    whose summed wavelet details lie above (below) the threshold, in robust spreads of its source; the threshold is what the
    largest of as many normal readings exceeds in a share `false_alarms` of all sources, and never below `floor`. stuck: part
    of a run of at least `run` (up to 95) equal non-zero readings in consecutive checks. Defined cases: repeated rows count
    once; a check without a reading (NULL) is no case and ends a run; rows with `total` = 0 are no cases and end a run; rows
    whose `time` is NULL come first, ties are ordered by row_id; a NULL source is a source of its own; an empty table gives no
    rows. Other columns are not read. Sources of very many rows are cut along time; 94 checks to each side of a cut are known
    on the other side, and the spread is that of the whole source.
    """
    names = [f"__s{i}" for i in range(len(source))]
    columns = [f"__x{i}" for i in range(len(readings))]
    base = df.select(
        *[F.col(s).alias(n) for s, n in zip(source, names)], F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), F.col(row_id).alias("__id"),
        (F.col(total).cast("double") if total else F.lit(None).cast("double")).alias("__total"), *[F.col(r.column).cast("double").alias(c) for r, c in zip(readings, columns)],
    )
    chunked = assign_chunks(base, names, ["__t", "__id"], piece)
    rows = chunked.with_neighbours(REACH)
    kind = base.schema["__id"].dataType
    keys = [base.schema[n] for n in names]
    out = T.StructType([*keys, T.StructField("__id", kind), *T.StructType.fromDDL("__f int, __wrong boolean, __stuck boolean, __d double, __limit double, __c int, __n bigint").fields])
    least = [stable(r.kind, np.empty(0))[1] for r in readings]

    def limit_of(histogram: np.ndarray, i: int) -> float:
        spread, n = scale_of(histogram, least[i])
        return threshold(n, false_alarms, floor) * spread

    def judge(part: pa.Table) -> pa.Table:
        """The implausible readings of a source in one piece. Of a piece of several, whose limit isn't known yet, the readings beyond
        the least limit there is, and the histograms: what a row carries stays small."""
        series, whole, found = _Series(part), not part.column("__is_cut")[0].as_py(), []
        one = part.select(names).slice(0, 1).combine_chunks()

        def add(i: int, n: int, **columns: pa.Array) -> None:
            same = {k: one.column(k).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in names}
            rest = {f.name: pa.nulls(n, t) for f, t in zip(out.fields[len(names) :], [series.ids.type, pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.int32(), pa.int64()])}
            found.append(pa.table(same | rest | {"__f": pa.array(np.full(n, i, np.int32))} | columns))

        for i, (column, r) in enumerate(zip(columns, readings)):
            held, v, wrong, d, histogram = series.field(column, r)
            limit = limit_of(histogram, i) if whole else floor * (NOISE * least[i])
            stuck = held & (v != 0) & (_runs(held, v) >= run)
            at = np.flatnonzero(series.own & (wrong | (np.abs(d) > limit) | stuck))
            known = {"__limit": pa.array(np.full(len(at), limit))} if whole else {}
            add(i, len(at), __id=series.ids.take(pa.array(at)), __wrong=pa.array(wrong[at]), __stuck=pa.array(stuck[at]), __d=pa.array(d[at]), **known)
            if not whole:
                c = np.flatnonzero(histogram)
                add(i, len(c), __c=pa.array(c.astype(np.int32)), __n=pa.array(histogram[c].astype(np.int64)))
        return pa.concat_tables(found)

    found = rows.groupBy(*names, CHUNK).applyInArrow(judge, out)
    limit = F.col("__limit")
    if chunked.cut:  # the limit is known only when all pieces of a source have been seen
        found = written(found, "readings")

        def over_pieces(part: pa.Table) -> pa.Table:
            histogram, i = np.zeros((HIGH - LOW) * FINE, np.int64), part.column("__f")[0].as_py()
            histogram[part.column("__c").to_numpy()] = part.column("__n").to_numpy()
            return part.select([*names, "__f"]).slice(0, 1).append_column("__of_all", pa.array([limit_of(histogram, i)]))

        cells = found.filter("__c is not null").groupBy(*names, "__f", "__c").agg(F.sum("__n").alias("__n"))
        limits = cut(cells.groupBy(*names, "__f").applyInArrow(over_pieces, T.StructType([*keys, *T.StructType.fromDDL("__f int, __of_all double").fields])))
        found = lookup(found.filter("__c is null"), limits, [*names, "__f"], limits.count())
        limit = F.coalesce(limit, "__of_all")
    field = F.array(*[F.lit(r.column) for r in readings])[F.col("__f")]
    spike, dip = F.coalesce(F.col("__d") > limit, F.lit(False)), F.coalesce(F.col("__d") < -limit, F.lit(False))
    flags = found.select(F.col("__id").alias(row_id), field.alias("field_name"), F.col("__wrong").alias("impossible"), spike.alias("spike"), dip.alias("dip"), F.col("__stuck").alias("stuck"))
    return flags.filter("impossible or spike or dip or stuck")
