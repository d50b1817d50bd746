"""References to records that don't exist: orphans by the state of the parent table at each moment.

Every parent row puts its key on record at one moment and may take it off at a later one. The state of a key is the number of
its rows on record. References probe that state; while it is 0 they wait, an arriving parent resolves what waits, and the
deletion of the last parent reopens it. timeline() follows the state of each key over a stretch of time; IncrementalOrphans in
tidegrid.streaming keeps it, and the references that wait, from stretch to stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import PIECE, assign_chunks


def parent_changes(parents: DataFrame, keys: list[str], recorded: str, deleted: str) -> DataFrame:
    """Changes (k0.., t, change) of the number of rows on record, in microseconds; a row deleted before or as it came never was.

    NULL in a key or in `recorded` is no record. Changes of one key at one moment are summed before the shuffle.
    """
    names = [f"k{i}" for i in range(len(keys))]
    at = [F.unix_micros(F.col(c).cast("timestamp")) for c in (recorded, deleted)]
    rows = parents.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], at[0].alias("since"), at[1].alias("till"))
    rows = rows.dropna(subset=[*names, "since"]).filter("till is null or till > since")
    both = F.array_compact(F.array(F.struct(F.col("since").alias("t"), F.lit(1).alias("change")), F.when(F.col("till").isNotNull(), F.struct(F.col("till").alias("t"), F.lit(-1).alias("change")))))
    return rows.select(*names, F.explode(both).alias("c")).groupBy(*names, "c.t").agg(F.sum("c.change").alias("change"))


def timeline(changes: DataFrame, refs: DataFrame, names: list[str], piece: int = PIECE) -> DataFrame:
    """Changes (names, t, change) and references (id, names, t) in order: is_ref, id, names, t, on_record, up, down, next_up, next_down.

    on_record is the number of parents after the row; up and down mark the changes by which it leaves and reaches 0; next_up
    and next_down are the moments of the next such changes behind the row. At one moment the changes come first; a NULL time
    comes before everything. Hot keys are cut along time, the state carried forwards and the next changes backwards.
    """
    both = changes.select(*names, "t", "change", F.lit(None).cast(refs.schema["id"].dataType).alias("id"), F.lit(0).alias("is_ref"))
    both = both.unionByName(refs.select(*names, "t", F.lit(0).cast("long").alias("change"), "id", F.lit(1).alias("is_ref")))
    chunked = assign_chunks(both, names, ["t", "is_ref", "id"], piece)
    rows = chunked.join_carry(chunked.carry({"net": F.sum("change")}, {"carried": (F.sum("net"), True)}), ["carried"], {"carried": "long"})
    order = [F.col("t").asc_nulls_first(), F.col("is_ref"), F.col("id")]
    to_here = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("on_record", F.coalesce("carried", F.lit(0)) + F.sum("change").over(chunked.window(*order).rowsBetween(*to_here))).drop("carried")
    before = F.col("on_record") - F.col("change")
    rows = rows.withColumns({"up": (F.col("on_record") > 0) & (before <= 0), "down": (F.col("on_record") <= 0) & (before > 0)})
    moments = {f: F.when(F.col(f), F.col("t")) for f in ("up", "down")}
    flips = chunked.again(rows)
    later = flips.carry({f"{f}_t": F.min(e) for f, e in moments.items()}, {f"later_{f}": (F.min(f"{f}_t"), False) for f in moments})
    rows = flips.join_carry(later, ["later_up", "later_down"], {"later_up": "long", "later_down": "long"})
    behind = flips.window(F.col("t").desc_nulls_last(), F.col("is_ref").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"next_{f}": F.coalesce(F.min(e).over(behind), F.col(f"later_{f}")) for f, e in moments.items()})
    return rows.select("is_ref", "id", *names, "t", "on_record", "up", "down", "next_up", "next_down")


def probe(
    references: DataFrame, parents: DataFrame, ref_id: str, ref_keys: list[str], ref_time: str,
    parent_keys: list[str], recorded: str, deleted: str, piece: int = PIECE,
) -> DataFrame:
    """Per reference (ref_id, ref_time as entered_us, answered, resolved_us): is its key on record at its own moment?

    A parent is on record from `recorded` on, until just before `deleted`. resolved_us is the first later moment at which the
    key is on record, NULL for answered references and for those still waiting at the end. Defined cases: references with a
    NULL key refer to nothing and are left out; a NULL ref_time comes before everything, so nothing answers it; rows repeated
    in every column count once; an empty parent table leaves all references unanswered. Other columns are not read.
    """
    names = [f"k{i}" for i in range(len(ref_keys))]
    refs = references_of(references, ref_id, ref_keys, ref_time)
    rows = timeline(parent_changes(parents, parent_keys, recorded, deleted), refs, names, piece).filter("is_ref = 1")
    answered = F.col("on_record") > 0
    return rows.select(F.col("id").alias(ref_id), *names, F.col("t").alias("entered_us"), answered.alias("answered"), F.when(~answered, F.col("next_up")).alias("resolved_us"))


def references_of(references: DataFrame, ref_id: str, ref_keys: list[str], ref_time: str) -> DataFrame:
    """References (id, k0.., t in microseconds), each once; those with a NULL key are left out."""
    names = [f"k{i}" for i in range(len(ref_keys))]
    refs = references.select(F.col(ref_id).alias("id"), *[F.col(k).alias(n) for k, n in zip(ref_keys, names)], F.unix_micros(F.col(ref_time).cast("timestamp")).alias("t"))
    return refs.dropna(subset=names).dropDuplicates()


def orphan_periods(orphans: DataFrame, field: str, entered: str, period: str = "month") -> DataFrame:
    """Counts of unanswered references per field and period of entry: field, period, orphans, resolved_later."""
    return orphans.groupBy(F.col(field), F.trunc(F.timestamp_micros(F.col(entered)).cast("date"), period).alias("period")).agg(
        F.count("*").alias("orphans"), F.count("resolved_us").alias("resolved_later")
    )
