"""Ordered work per key when one key may hold a large share of all rows.

A window over a key puts all its rows into one task. Here long keys are cut along their order into pieces of bounded size;
what has to pass from piece to piece is summed up per piece and carried over the summaries.

Where to cut is decided by the rows themselves: a row whose hash falls below a threshold is a mark, and every fourth mark of a
key is a cut. One narrow pass finds the marks, nothing has to be counted first, a short key has no cut, and the expected size
of a piece is the same for every table, however large.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.shared import cut as written

CHUNK = "__chunk"
#: Rows of a piece, on average. Sizes follow a gamma distribution of MARKS parts: one piece in a million has over five times as many.
PIECE = 500_000
#: Marks per piece.
MARKS = 4
#: Tables joined to the rows are sent to all tasks up to so many rows (or cuts), beyond that they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Copies of a looked-up row in a join by shuffle, so that the rows of one hot key go to so many tasks.
SALTS = 32


def same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of the keys of two aliased tables, NULL being a key."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def lookup(df: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "left") -> DataFrame:
    """`df` with the other columns of `small`, which has `rows` rows, one per key: broadcast while few, else by a salted shuffle.

    The salt spreads a hot key of `df` over SALTS tasks; NULL is a key.
    """
    extra = [c for c in small.columns if c not in keys]
    if rows <= BROADCAST_ROWS:
        return df.alias("l").join(F.broadcast(small.alias("r")), same("l", "r", keys), how).select("l.*", *[F.col(f"r.{c}") for c in extra])
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = salted.alias("l").join(copies.alias("r"), same("l", "r", keys) & (F.col("l.__salt") == F.col("r.__salt")), how)
    return out.select(*[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in extra])


@dataclass
class Chunked:
    """`df` has the column CHUNK, 0 for every row of a key that was not cut; `cut` tells whether any key was; `cuts` counts them."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool
    cuts: int = 0

    def window(self, *order: Column) -> Window:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*order)

    def carry(self, parts: dict[str, Column], merge: dict[str, tuple[Column, bool]]) -> DataFrame | None:
        """Per key and piece the value carried in from the other pieces; None if no key was cut.

        parts: aggregates made per piece. merge: by output name an aggregate over the names in parts, and whether it runs
        over the pieces before (True) or, from the far end, over those after (False). Only keys with a cut are summed up.
        """
        if not self.cut:
            return None
        sums = self.df.filter("__is_cut").groupBy(*self.keys, CHUNK).agg(*[e.alias(n) for n, e in parts.items()])
        before = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        out = sums.select(*self.keys, CHUNK, *[e.over(before if fwd else after).alias(n) for n, (e, fwd) in merge.items()])
        return out.filter(" or ".join(f"`{n}` is not null" for n in merge))

    def join_carry(self, carried: DataFrame | None, names: list[str], types: dict[str, str]) -> DataFrame:
        """The rows with the carried columns, NULL where nothing is carried."""
        if carried is None:
            return self.df.withColumns({n: F.lit(None).cast(types[n]) for n in names})
        # One row per piece; a piece is a key of its own here, so no key is hot.
        keys = [*self.keys, CHUNK]
        right = F.broadcast(carried) if 2 * self.cuts <= BROADCAST_ROWS else carried
        out = self.df.alias("l").join(right.alias("r"), same("l", "r", keys), "left")
        return out.select("l.*", *[F.col(f"r.{n}") for n in names])

    def again(self, df: DataFrame) -> Chunked:
        """The same cuts for rows derived from these, for a second carry."""
        return Chunked(df, self.keys, self.order, self.cut, self.cuts)

    def with_neighbours(self, reach: int) -> DataFrame:
        """The rows, and as copies with __beyond = True the `reach` rows before and after each piece (from up to two pieces)."""
        own = self.df.withColumn("__beyond", F.lit(False))
        if not self.cut:
            return own
        cols = [c for c in self.df.columns if c not in (*self.keys, CHUNK, "__is_cut")]
        row = F.struct(*self.order, *[c for c in cols if c not in self.order])
        piece = Window.partitionBy(*self.keys, CHUNK)
        asc, desc = [F.col(c).asc_nulls_first() for c in self.order], [F.col(c).desc_nulls_last() for c in self.order]
        ends = self.df.filter("__is_cut").select(*self.keys, CHUNK, row.alias("row"), F.row_number().over(piece.orderBy(*asc)).alias("a"), F.row_number().over(piece.orderBy(*desc)).alias("z"))
        ends = ends.filter((F.col("a") <= reach) | (F.col("z") <= reach)).groupBy(*self.keys, CHUNK).agg(
            F.sort_array(F.collect_list(F.when(F.col("a") <= reach, F.col("row")))).alias("head"), F.sort_array(F.collect_list(F.when(F.col("z") <= reach, F.col("row")))).alias("tail")
        )
        w = Window.partitionBy(*self.keys).orderBy(CHUNK)
        none = F.array().cast(ends.schema["head"].dataType)
        back = F.concat(F.coalesce(F.lag("tail", 2).over(w), none), F.coalesce(F.lag("tail", 1).over(w), none))
        ahead = F.concat(F.coalesce(F.lead("head", 1).over(w), none), F.coalesce(F.lead("head", 2).over(w), none))
        near = ends.select(*self.keys, CHUNK, back.alias("b"), ahead.alias("f"))
        near = near.select(*self.keys, CHUNK, F.explode(F.concat(F.slice("b", F.greatest(F.size("b") - reach + 1, F.lit(1)), reach), F.slice("f", 1, reach))).alias("row"))
        return own.unionByName(near.select(*self.keys, CHUNK, *[F.col(f"row.{c}") for c in cols], F.lit(True).alias("__is_cut"), F.lit(True).alias("__beyond")))


def _piece_of(cuts: Column, at: Column, steps: int) -> Column:
    """How many of the ascending cuts lie below `at`, by halving."""
    first = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(cuts, mid) < at, F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, halve)["lo"]


def assign_chunks(df: DataFrame, keys: list[str], order: str | list[str], piece: int = PIECE, source: DataFrame | None = None) -> Chunked:
    """Cut long keys along `order` (columns that compare, the last ones breaking ties) into pieces of about `piece` rows.

    Rows equal in all columns of `order` stay together; give enough of them to tell rows apart. NULLs come first. The result
    of an operator doesn't depend on the cuts. One job runs at once, a narrow pass for the marks; `source` may be a cheaper
    table with the same keys and order values (repeated rows don't matter) in which they are sought.
    """
    order = [order] if isinstance(order, str) else list(order)
    at = F.struct(*[F.col(c) for c in order])
    marks = (source if source is not None else df).filter(F.pmod(F.xxhash64(*keys, *order), F.lit(max(MARKS, piece))) < MARKS)
    marks = marks.select(*keys, at.alias("at")).groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("all"))
    every = F.filter("all", lambda _, i: i % MARKS == MARKS - 1)
    table = written(marks.select(*keys, every.alias("__cuts")).filter(F.size("__cuts") > 0))
    top = table.agg(F.count("*").alias("n"), F.sum(F.size("__cuts")).alias("cuts"), F.max(F.size("__cuts")).alias("most")).first()
    if not top["n"]:
        return Chunked(df.withColumns({CHUNK: F.lit(0), "__is_cut": F.lit(False)}), keys, order, False)
    rows = lookup(df, table, keys, top["cuts"])
    where = F.when(F.col("__cuts").isNotNull(), _piece_of(F.col("__cuts"), at, math.ceil(math.log2(top["most"] + 1)) + 1)).otherwise(0)
    return Chunked(rows.withColumns({CHUNK: where.cast("int"), "__is_cut": F.col("__cuts").isNotNull()}).drop("__cuts"), keys, order, True, int(top["cuts"]))
