"""Pairing the rows of two tables by nearest time per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import PIECE, assign_chunks


def nearest_in_time(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_entity: str, right_entity: str,
    left_time: str, right_time: str, tolerance: int, piece: int = PIECE,
) -> DataFrame:
    """One row (left_id, right_id, distance) per left row with a right row of its entity at most `tolerance` away: the nearest.

    Both tables are united and sorted per entity and time; the last right row before and the next one after are carried onto
    each left row, and the nearer one is taken. Entities with very many rows are cut along time, the carried rows passing from
    cut to cut. Defined cases: rows with a NULL entity or time pair with nothing; repeated rows count once; at equal distances
    the earlier right row wins, of right rows at one time that with the least id; an empty table gives no rows. Other columns
    are not read, so equal names on both sides don't clash.
    """
    pick = [F.col(left_entity).alias("e"), F.col(left_time).cast("long").alias("t"), F.col(left_id).alias("lid")]
    lefts = left.select(*pick).dropna(subset=["e", "t"]).dropDuplicates()
    rights = right.select(F.col(right_entity).alias("e"), F.col(right_time).cast("long").alias("t"), F.col(right_id).alias("rid")).dropna(subset=["e", "t"])
    rights = rights.groupBy("e", "t").agg(F.min("rid").alias("rid"))
    both = lefts.withColumns({"hit": F.lit(None).cast(f"struct<t:bigint,rid:{rights.schema['rid'].dataType.simpleString()}>"), "is_left": F.lit(True)}).unionByName(
        rights.select("e", "t", F.lit(None).cast(lefts.schema["lid"].dataType).alias("lid"), F.struct("t", "rid").alias("hit"), F.lit(False).alias("is_left"))
    )
    chunked = assign_chunks(both, ["e"], ["t", "is_left", "lid"], piece)
    carried = chunked.carry({"head": F.min("hit"), "tail": F.max("hit")}, {"c_last": (F.max("tail"), True), "c_next": (F.min("head"), False)})
    kind = both.schema["hit"].dataType.simpleString()
    rows = chunked.join_carry(carried, ["c_last", "c_next"], {"c_last": kind, "c_next": kind})
    to_here = (Window.unboundedPreceding, 0)
    ahead = chunked.window(F.col("t"), F.col("is_left")).rowsBetween(*to_here)
    behind = chunked.window(F.col("t").desc(), F.col("is_left")).rowsBetween(*to_here)
    rows = rows.withColumns({
        "prev": F.coalesce(F.last("hit", ignorenulls=True).over(ahead), F.col("c_last")),
        "next": F.coalesce(F.last("hit", ignorenulls=True).over(behind), F.col("c_next")),
    }).filter("is_left")
    before, after = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
    first = F.coalesce(before <= after, F.col("prev").isNotNull())
    rows = rows.select("lid", F.when(first, F.col("prev.rid")).otherwise(F.col("next.rid")).alias("rid"), F.when(first, before).otherwise(after).alias("distance"))
    return rows.filter(F.col("distance") <= tolerance).select(F.col("lid").alias(left_id), F.col("rid").alias(right_id), "distance")
