"""Percentiles of large numeric columns per group by radix selection.

A floating value is mapped to an integer of the same order. Counts by the leading bits of that integer are made per day and
group; they can be added up over days and partitions, and bound every percentile by one bucket. For the exact value the bits
are followed down: only rows in the buckets that hold a wanted rank are counted by their next digit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.chunked import lookup
from tidegrid.functions.shared import cut

#: Bits of the successive digits; they sum to 64. The first holds sign, exponent and 10 bits of the fraction.
DIGITS = (22, 21, 21)


def order_preserving(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def from_ordered(k: pd.Series) -> pd.Series:
    keys = k.to_numpy(np.int64)
    return pd.Series((keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _udf(f, kind: str):
    return F.pandas_udf(f, kind)


def ordered_values(df: DataFrame, groups: list[str], values: list[str], day: str | None = None) -> DataFrame:
    """Rows (groups.., day, field, key) of all values that count: not NULL and not NaN; -0.0 is 0.0."""
    names = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("x")) for v in values])
    long = df.select(*names, (F.col(day) if day else F.lit(None).cast("date")).alias("day"), F.explode(cells).alias("c")).select(*[f"g{i}" for i in range(len(groups))], "day", "c.*")
    return long.filter(F.col("x").isNotNull() & ~F.isnan("x")).select(*[f"g{i}" for i in range(len(groups))], "day", "field", _udf(order_preserving, "long")("x").alias("key"))


def day_histograms(df: DataFrame, groups: list[str], values: list[str], day: str, bits: int = DIGITS[0]) -> DataFrame:
    """The mergeable result of a day: groups.., day, field, bucket (the leading bits), n. Results of parts are added up."""
    g = [f"g{i}" for i in range(len(groups))]
    out = ordered_values(df, groups, values, day).groupBy(*g, "day", "field", F.shiftright("key", 64 - bits).alias("bucket")).agg(F.count("*").alias("n"))
    return out.select(*[F.col(a).alias(b) for a, b in zip(g, groups)], F.col("day").alias(day), "field", "bucket", "n")


def _ranks(total: Column, percentiles: list[float]) -> Column:
    """The two ranks around each percentile, as for linear interpolation."""
    at = [(p, F.lit(p / 100.0) * (total - 1)) for p in percentiles]
    both = [F.struct(F.lit(p).cast("double").alias("p"), F.lit(side).alias("side"), r.cast("long").alias("rank")) for p, x in at for side, r in ((0, F.floor(x)), (1, F.ceil(x)))]
    return F.array(*both)


def _follow(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of counts (keys.., up, bucket, n, wanted) the buckets that hold a wanted rank, with the ranks left inside them."""
    w = Window.partitionBy(*keys, "up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("from", F.col("upto") - F.col("n"))
    inside = F.filter("wanted", lambda x: (x["rank"] >= F.col("from")) & (x["rank"] < F.col("upto")))
    counts = counts.withColumn("wanted", F.transform(inside, lambda x: F.struct(x["p"].alias("p"), x["side"].alias("side"), (x["rank"] - F.col("from")).alias("rank"))))
    return counts.filter(F.size("wanted") > 0).select(*keys, F.col("bucket").alias("up"), "wanted")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which NULL is one."""
    on = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = same if on is None else on & same
    return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def _first_level(hist: DataFrame, keys: list[str], percentiles: list[float]) -> tuple[DataFrame, DataFrame]:
    totals = hist.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = totals.withColumn("wanted", _ranks(F.col("total"), percentiles))
    counts = _join(hist.withColumn("up", F.lit(0).cast("long")), wanted.drop("total"), keys)
    return totals, _follow(counts, keys)


def percentiles(df: DataFrame, groups: list[str], values: list[str], wanted: list[float]) -> DataFrame:
    """Exact percentiles, between two values by linear interpolation: groups.., field, percentile, n, value.

    Histogram by the first digit, then two passes over the rows whose leading bits hold a wanted rank. No group is gathered
    or sorted: what a group sends is bounded by the buckets of a digit. Defined cases: NULL and NaN don't count, infinities
    do, -0.0 is 0.0; a NULL group is a group; a group without values has no rows; repeated values count each; between an
    infinity and another value the nearer rank's value is taken. The buckets followed from pass to pass are written to the
    shared checkpoint folder, so a pass doesn't repeat those before.
    """
    return percentiles_of(ordered_values(df, groups, values), groups, wanted)


def percentiles_of(rows: DataFrame, groups: list[str], wanted: list[float]) -> DataFrame:
    """percentiles() over the output of ordered_values, of one table or several united."""
    g = [f"g{i}" for i in range(len(groups))]
    keys = [*g, "field"]
    shift = 64 - DIGITS[0]
    hist = rows.groupBy(*keys, F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("n"))
    totals, follow = _first_level(cut(hist), keys, wanted)
    for bits in DIGITS[1:]:
        parent, shift = shift, shift - bits
        follow = cut(follow)
        narrow = follow.select(*keys, "up")
        # A bucket that holds most rows of a hot group is spread over tasks where the buckets are too many to broadcast.
        inside = lookup(rows.withColumn("up", F.shiftright("key", parent)), narrow.withColumn("__followed", F.lit(True)), [*keys, "up"], narrow.count(), "inner").drop("__followed")
        hist = inside.groupBy(*keys, "up", F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("n"))
        follow = _follow(_join(hist, follow, [*keys, "up"]), keys)
    found = follow.select(*keys, F.explode("wanted").alias("w"), _udf(from_ordered, "double")("up").alias("x")).select(*keys, "w.p", "w.side", "x")
    ends = found.groupBy(*keys, "p").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("high"))
    out = _join(ends, totals.withColumnRenamed("total", "n"), keys)
    at = (F.col("p") / 100.0) * (F.col("n") - 1)
    part = at - F.floor(at)
    infinite = (F.abs("low") == float("inf")) | (F.abs("high") == float("inf"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).when(infinite, F.when(part < 0.5, F.col("low")).otherwise(F.col("high")))
    value = value.otherwise(F.col("low") + (F.col("high") - F.col("low")) * part)
    return out.select(*[F.col(a).alias(b) for a, b in zip(g, groups)], "field", F.col("p").alias("percentile"), "n", value.alias("value"))


def combine(histograms: DataFrame, groups: list[str], wanted: list[float], bits: int = DIGITS[0]) -> DataFrame:
    """Percentiles from day histograms alone: groups.., field, percentile, n, least, most; the true value lies between them.

    The bounds are those of the buckets around the percentile: with the default bits they differ by less than 0.1 % of the
    value if both ranks share a bucket. Adding up histograms of other days or parts before gives the same as one of all rows.
    """
    g = [f"g{i}" for i in range(len(groups))]
    keys = [*g, "field"]
    hist = histograms.select(*[F.col(a).alias(b) for a, b in zip(groups, g)], "field", "bucket", "n").groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    totals, follow = _first_level(hist, keys, wanted)
    shift = 64 - bits
    low = F.shiftleft("up", shift)
    ends = follow.select(*keys, F.explode("wanted").alias("w"), _udf(from_ordered, "double")(low).alias("low"), _udf(from_ordered, "double")(low + F.lit((1 << shift) - 1)).alias("high"))
    out = ends.groupBy(*keys, "w.p").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    out = _join(out, totals.withColumnRenamed("total", "n"), keys)
    return out.select(*[F.col(a).alias(b) for a, b in zip(g, groups)], "field", F.col("p").alias("percentile"), "n", "least", "most")
