"""The row before and running sums, per key and in order, also where one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import CHUNK, PIECE, assign_chunks


def with_previous(df: DataFrame, keys: list[str], order: str, columns: list[str], tie: tuple[str, ...] = (), piece: int = PIECE, source: DataFrame | None = None) -> DataFrame:
    """`df` with `before`: a struct of order, tie and columns of the row before in the order (order, tie), NULL for the first of a key.

    order is a LONG. Long keys are cut along it, and the last row of each piece is carried on to the next.
    """
    by = [order, *[t for t in tie if t != order]]
    c = assign_chunks(df, keys, by, piece, source)
    last = F.struct(F.col(order).cast("long").alias("__o"), *dict.fromkeys([*by[1:], *columns]))
    kind = c.df.select(last.alias("s")).schema["s"].dataType.simpleString()
    rows = c.join_carry(c.carry({"end": F.max(last)}, {"__c": (F.max("end"), True)}), ["__c"], {"__c": kind})
    return rows.withColumn("before", F.coalesce(F.lag(last).over(c.window(*[F.col(b) for b in by])), F.col("__c"))).drop("__c", "__is_cut", CHUNK)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], before: bool = False, piece: int = PIECE) -> DataFrame:
    """`df` with the running sums of the expressions, up to and including the row or, with `before`, of the rows before it.

    NULL where no value has been summed. No keys means one series of all rows; it is cut like any long key, so no task orders
    all of it. `order` should tell rows apart.
    """
    series = keys or ["__all"]
    d = df.withColumns({f"__v_{n}": e for n, e in sums.items()})
    d = d if keys else d.withColumn("__all", F.lit(0))
    c = assign_chunks(d, series, order, piece)
    kinds = {f"__c_{n}": d.select(F.sum(f"__v_{n}").alias("s")).schema["s"].dataType.simpleString() for n in sums}
    carried = c.carry({f"s_{n}": F.sum(f"__v_{n}") for n in sums}, {f"__c_{n}": (F.sum(f"s_{n}"), True) for n in sums})
    rows = c.join_carry(carried, list(kinds), kinds)
    w = c.window(*[F.col(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = {}
    for n in sums:
        own, far = F.sum(f"__v_{n}").over(w), F.col(f"__c_{n}")
        out[n] = F.when(own.isNotNull() & far.isNotNull(), own + far).otherwise(F.coalesce(own, far))
    return rows.withColumns(out).select(*df.columns, *[n for n in sums if n not in df.columns])
