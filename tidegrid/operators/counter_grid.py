"""Irregular readings onto a regular grid.

Consecutive readings of a series are differenced, and what lies between two of them is laid over the cells of the grid: the
growth of a cumulative counter in proportion to the overlap (a fall of the counter is a reset), the earlier reading to the
points between, and a mark on the points at which that reading is too old. Readings of one cell are reduced before the
shuffle to what its neighbours need of them, so a series is never longer than its grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import PIECE, assign_chunks


@dataclass(frozen=True)
class Grid:
    """Points start, start + step, .. up to end, both ends included; a reading covers the points less than `reach` after it."""

    name: str
    start: int
    end: int
    step: int
    reach: int

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step + 1


def read_grids(df: DataFrame, scale: int = 1_000_000, most: int = 1000) -> list[Grid]:
    """The grids of a parameter table (grid_name, step_ms, start_ms, end_ms, max_age_ms), times `scale` (ns in a ms).

    Grids are parameters of a query, not data: more than `most` are an error.
    """
    rows = df.select("grid_name", "start_ms", "end_ms", "step_ms", "max_age_ms").dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} grids")
    return sorted((Grid(r[0], *[int(v) * scale for v in r[1:]]) for r in rows), key=lambda g: g.name)


def ceil_div(x: Column, step: int) -> Column:
    """ceil(x / step) of LONGs without floating point; pmod keeps the remainder positive below zero too."""
    by = F.lit(step).cast("long")
    return F.call_function("div", x + F.pmod(-x, by), by)


def _spread(df: DataFrame, grids: list[Grid], grid_column: str | None, make) -> DataFrame:
    """`df` with one row per grid that a row belongs to: all, or the one its grid_column names."""
    parts = [F.when(F.lit(True) if grid_column is None else F.coalesce(F.col(grid_column) == g.name, F.lit(False)), make(i, g)) for i, g in enumerate(grids)]
    return df.withColumn("__x", F.explode(F.array_compact(F.array(*parts))))


def _by_grid(grids: list[Grid], of) -> Column:
    out = F.lit(None)
    for i, g in enumerate(grids):
        out = F.when(F.col("__grid") == i, of(g)).otherwise(out)
    return out


def cell_of(o: Column, g: Grid) -> Column:
    """Index of the first point at or after the offset, between 0 and the number of points; that number for NULL."""
    at = F.least(F.greatest(ceil_div(o - g.start, g.step), F.lit(0)), F.lit(g.points))
    return F.coalesce(at, F.lit(g.points)).cast("int")


def missing_points(df: DataFrame, keys: list[str], offset: str, grids: list[Grid], grid_column: str | None = None) -> DataFrame:
    """One row (keys, grid_name, offset) per grid point of a series without a reading in (point - reach, point].

    Each pair of consecutive readings leaves the interval from the end of the first one's reach to the second one uncovered;
    so do the time before the first reading and that after the reach of the last. Points in uncovered intervals are missing.
    Of a cell only the first and the last reading matter, as an interval between readings of one cell holds no point. Defined
    cases: a series whose offsets are all NULL or off the grid misses every point; repeated rows and ties change nothing; a
    NULL key is a key; a row whose grid_column is NULL or names no grid belongs to no grid; an empty table or no grid gives no
    rows. Other columns are not read.
    """
    if not grids:
        return df.select(*keys, F.lit("").alias("grid_name"), F.col(offset).alias("offset")).limit(0)
    names = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(offset).cast("long").alias("__o"), *([F.col(grid_column)] if grid_column else []))
    rows = _spread(base, grids, grid_column, lambda i, g: F.struct(F.lit(i).alias("grid"), cell_of(F.col("__o"), g).alias("cell")))
    cells = rows.groupBy(*names, F.col("__x.grid").alias("__grid"), F.col("__x.cell").alias("cell")).agg(F.min("__o").alias("first"), F.max("__o").alias("last"))
    w = Window.partitionBy(*names, "__grid").orderBy("cell")
    points = _by_grid(grids, lambda g: F.lit(g.points))

    def until(end: Column) -> Column:
        """The first point beyond the reach of a reading."""
        return _by_grid(grids, lambda g: F.greatest(ceil_div(end + g.reach - g.start, g.step), F.lit(0)).cast("int"))

    # The interval before each cell's first reading, and behind the last reading of all.
    cells = cells.select("*", F.lag("last").over(w).alias("from"), F.lead("cell").over(w).isNull().alias("ends"))
    before = F.struct(F.coalesce(until(F.col("from")), F.lit(0)).alias("low"), (F.col("cell") - 1).alias("high"))
    behind = F.when(F.col("ends") & (F.col("cell") < points), F.struct(until(F.col("last")).alias("low"), (points - 1).alias("high")))
    gaps = cells.select(*names, "__grid", F.explode(F.array_compact(F.array(before, behind))).alias("u")).filter("u.low <= u.high")
    out = gaps.select(*names, "__grid", F.explode(F.sequence("u.low", "u.high")).alias("j"))
    return out.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        _by_grid(grids, lambda g: F.lit(g.name)).cast("string").alias("grid_name"),
        _by_grid(grids, lambda g: F.lit(g.start).cast("long") + F.col("j") * F.lit(g.step).cast("long")).alias("offset"),
    )


def moment(time: str, tie: str) -> Column:
    """Time and a non-negative tie-breaker as one number, so that an aggregation by it needs no sorting."""
    return F.col(time).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.coalesce(F.col(tie), F.lit(0)).cast("decimal(20,0)")


def last_readings(
    df: DataFrame, keys: list[str], offset: str, tie: list[str], state: list[str], grids: list[Grid], grid_column: str | None = None
) -> DataFrame:
    """Every grid point of every series (keys, grid_name, offset, state.., age, missing) with the last reading at or before it.

    Ticks collapse to the last one per cell before the shuffle; the interval from it to the next cell's reading is laid over
    the points between, so there is neither a spine nor an as-of join. Of readings with one offset the greatest `tie` counts;
    with one tie column of whole numbers from 0 on nothing is sorted but the cells. A point is missing, its state NULL, if its
    reading is `reach` old or older; a reading with NULL state is a reading. Defined cases as in missing_points; readings
    before the grid hold at its start while they are young enough.
    """
    if not grids:
        return df.select(*keys, F.lit("").alias("grid_name"), F.col(offset).alias("offset"), *state, F.col(offset).alias("age"), F.lit(True).alias("missing")).limit(0)
    o = F.col("__o")

    def cell(i: int, g: Grid) -> Column:
        return F.struct(F.lit(i).alias("grid"), cell_of(o, g).alias("cell"))

    names = [f"__k{i}" for i in range(len(keys))]
    plain = len(tie) == 1 and df.schema[tie[0]].dataType.typeName() in ("byte", "short", "integer", "long")
    columns = [F.col(c).alias(f"__s{i}") for i, c in enumerate(state)]
    base = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(offset).cast("long").alias("__o"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)], *columns,
        *([F.col(grid_column)] if grid_column else []),
    )
    rows = _spread(base, grids, grid_column, cell).withColumns({"__grid": F.col("__x.grid"), "cell": F.col("__x.cell")})
    held = [f"__s{i}" for i in range(len(state))]
    if plain:
        by = moment("__o", "__t0")
        cells = rows.groupBy(*names, "__grid", "cell").agg(F.max("__o").alias("__o"), *[F.max_by(c, by).alias(c) for c in held])
    else:
        by = F.struct("__o", *[f"__t{i}" for i in range(len(tie))])
        cells = rows.groupBy(*names, "__grid", "cell").agg(F.max_by(F.struct("__o", *held), by).alias("r")).select(*names, "__grid", "cell", "r.*")
    w = Window.partitionBy(*names, "__grid").orderBy("cell")
    n = _by_grid(grids, lambda g: F.lit(g.points))
    cells = cells.select("*", F.lead("cell").over(w).alias("next"), F.lag("cell").over(w).alias("before"))
    low = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.col("cell"))
    high = F.coalesce(F.col("next"), n) - 1
    points = cells.filter(low <= high).select("*", F.explode(F.sequence(low, high)).alias("j"))
    at = _by_grid(grids, lambda g: F.lit(g.start).cast("long") + F.col("j") * F.lit(g.step).cast("long"))
    points = points.withColumn("at", at).withColumn("age", F.when(F.col("j") >= F.col("cell"), F.col("at") - F.col("__o")))
    missing = F.coalesce(F.col("age") >= _by_grid(grids, lambda g: F.lit(g.reach).cast("long")), F.lit(True))
    points = points.withColumn("missing", missing)
    return points.select(
        *[F.col(n_).alias(k) for k, n_ in zip(keys, names)],
        _by_grid(grids, lambda g: F.lit(g.name)).cast("string").alias("grid_name"),
        F.col("at").alias("offset"),
        *[F.when(~F.col("missing"), F.col(c)).alias(s) for s, c in zip(state, held)],
        F.when(~F.col("missing"), F.col("age")).alias("age"),
        "missing",
    )


def differences(df: DataFrame, names: list[str], piece: int = PIECE) -> DataFrame:
    """Consecutive readings (names, t, v) of each series: names, from, t, grow, reset.

    A reading below the one before is a reset, after which the counter grew from 0 to it. Of readings at one time the greatest
    counts. Series of very many readings are cut along time, the last reading of a piece being carried on.
    """
    once = df.groupBy(*names, "t").agg(F.max("v").alias("v"))
    chunked = assign_chunks(once, names, "t", piece, df)
    carried = chunked.carry({"end": F.max(F.struct("t", "v"))}, {"c": (F.max("end"), True)})
    rows = chunked.join_carry(carried, ["c"], {"c": once.select(F.struct("t", "v").alias("c")).schema["c"].dataType.simpleString()})
    rows = rows.withColumn("p", F.coalesce(F.lag(F.struct("t", "v")).over(chunked.window(F.col("t"))), F.col("c"))).filter("p is not null")
    reset = F.col("v") < F.col("p.v")
    return rows.select(*names, F.col("p.t").alias("from"), "t", F.when(reset, F.col("v")).otherwise(F.col("v") - F.col("p.v")).alias("grow"), reset.alias("reset"))


def counters_to_grids(df: DataFrame, keys: list[str], time: str, value: str, grids: list[Grid], piece: int = PIECE) -> DataFrame:
    """Growth of a cumulative counter per cell (point - step, point] of each grid: keys, grid_name, offset, growth, resets, covered.

    Consecutive readings are differenced once. The growth between two readings goes to the cells they span, in proportion to
    the overlap. covered is the share of the cell that lies between readings less than `reach` apart; a cell with none is
    uncovered and has no growth (NULL). Growth across a longer silence is spread too, but its cells count as uncovered there.
    Defined cases: NULL times and values are left out; of readings at one time the greatest value counts; a single reading
    gives no growth; only cells that readings span have rows; no grid gives no rows.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v"))
    rows = differences(base.dropna(subset=["t", "v"]), names, piece)

    def cells(i: int, g: Grid) -> Column:
        low, high = [F.least(F.greatest(x, F.lit(0)), F.lit(g.points - 1)).cast("int") for x in (ceil_div(F.col("from") + 1 - g.start, g.step), ceil_div(F.col("t") - g.start, g.step))]
        near = (F.col("t") > g.start - g.step) & (F.col("from") < g.end)
        return F.when(near, F.transform(F.sequence(low, high), lambda j: F.struct(F.lit(i).alias("grid"), (F.lit(g.start).cast("long") + j * F.lit(g.step).cast("long")).alias("end"))))

    none = F.array().cast("array<struct<grid:int,end:bigint>>")
    rows = rows.withColumn("x", F.explode(F.flatten(F.array_compact(F.array(none, *[cells(i, g) for i, g in enumerate(grids)]))))).withColumns({"__grid": F.col("x.grid"), "offset": F.col("x.end")})
    step = _by_grid(grids, lambda g: F.lit(g.step).cast("long")).cast("long")
    overlap = F.greatest(F.least("t", "offset") - F.greatest(F.col("from"), F.col("offset") - step), F.lit(0))
    rows = rows.withColumns({"step": step, "overlap": overlap, "near": (F.col("t") - F.col("from")) < _by_grid(grids, lambda g: F.lit(g.reach).cast("long"))}).filter("overlap > 0")
    out = rows.groupBy(*names, "__grid", "offset").agg(
        F.sum(F.col("grow") * F.col("overlap") / (F.col("t") - F.col("from"))).alias("growth"),
        F.count_if(F.col("reset") & (F.col("t") > F.col("offset") - F.col("step")) & (F.col("t") <= F.col("offset"))).alias("resets"),
        (F.sum(F.when(F.col("near"), F.col("overlap")).otherwise(0)) / F.first("step")).alias("covered"),
    )
    name = _by_grid(grids, lambda g: F.lit(g.name)).cast("string").alias("grid_name")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], name, "offset", F.when(F.col("covered") > 0, F.col("growth")).alias("growth"), "resets", "covered")


def counter_to_grid(df: DataFrame, keys: list[str], time: str, value: str, grid: Grid, piece: int = PIECE) -> DataFrame:
    """counters_to_grids on one grid, without its name."""
    return counters_to_grids(df, keys, time, value, [grid], piece).drop("grid_name")
