"""Statistics kernels: robust regression, false discovery rates, resampling of events."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The multipliers of the portable resampler, so that any engine draws the same events.
REP_STEP, SLOT_STEP, MULTIPLIER, MODULUS = 7919, 104729, 48271, 2147483647


@F.pandas_udf(T.DoubleType())
def normal_p(t: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return t.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


def ols_hc3(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group the line y = alpha + beta x with HC3 standard errors: keys, n_events, alpha, beta, se_hc3, t, r2.

    One aggregation gives the moments; they are joined back and the leverage-weighted squares aggregated again; no group is
    gathered. Rows with a NULL x or y are left out; fewer than 3 rows, or a constant x, give NULL; a point of leverage 1 gives
    NULL errors.
    """
    d = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    m = d.groupBy(*keys).agg(
        F.count_if(both).alias("n"), F.regr_avgx("y", "x").alias("mx"), F.regr_avgy("y", "x").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"),
        F.coalesce(F.max(F.when(both, F.col("x"))) > F.min(F.when(both, F.col("x"))), F.lit(False)).alias("varied"),
    )
    m = m.withColumn("beta", F.when((F.col("n") >= 3) & F.col("varied"), F.try_divide("sxy", "sxx")))
    r = _back(d, m, keys).withColumns({"dx": F.col("x") - F.col("mx"), "e": (F.col("y") - F.col("my")) - F.col("beta") * (F.col("x") - F.col("mx"))})
    left = 1 - F.try_divide(F.lit(1.0), F.col("n")) - F.try_divide(F.col("dx") * F.col("dx"), F.col("sxx"))
    left = F.when(F.abs(left) > 1e-12, left)
    moments = [c for c in m.columns if c not in keys]
    s = r.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in moments], F.sum(F.when(both, F.pow(F.try_divide(F.col("dx") * F.col("e"), left), 2))).alias("v"),
        F.count_if(both & left.isNull() & (F.col("dx") != 0)).alias("full"), F.sum(F.when(both, F.col("e") * F.col("e"))).alias("sse"),
    )
    s = s.withColumn("se_hc3", F.when(F.col("beta").isNotNull() & (F.col("full") == 0), F.sqrt("v") / F.col("sxx")))
    return s.select(
        *keys, F.col("n").alias("n_events"), (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), "beta", "se_hc3", F.try_divide("beta", "se_hc3").alias("t"),
        F.when(F.col("beta").isNotNull(), 1 - F.try_divide("sse", "syy")).alias("r2"),
    )


def _back(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    on = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = same if on is None else on & same
    if on is None:
        return left.crossJoin(right)
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def benjamini_hochberg(df: DataFrame, p: str, alpha: float, family: list[str] | None = None) -> DataFrame:
    """`df` with q_bh and survives_fdr: step-up adjustment within a family of tests; a NULL p has NULL q and doesn't survive.

    The tests of a family are ordered in one window: a family is one table of results, not data.
    """
    family = family or []
    tested = df.filter(F.col(p).isNotNull())
    asc = Window.partitionBy(*family).orderBy(F.col(p))
    up = Window.partitionBy(*family).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.count("*").over(Window.partitionBy(*family))
    # Of equal p-values the greatest rank counts.
    rank = F.count("*").over(asc.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tested = tested.withColumn("__r", F.col(p) * m / rank)
    tested = tested.withColumn("q_bh", F.least(F.min("__r").over(up), F.lit(1.0))).drop("__r").withColumn("survives_fdr", F.col("q_bh") <= alpha)
    untested = df.filter(F.col(p).isNull()).withColumns({"q_bh": F.lit(None).cast("double"), "survives_fdr": F.lit(False)})
    return tested.unionByName(untested)


def draws(n: int, reps: int, seed: int) -> np.ndarray:
    """reps x n indices of resampled events; the same in every engine."""
    r, s = np.arange(reps, dtype=np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :]
    return ((r * REP_STEP + s * SLOT_STEP + seed) * MULTIPLIER % MODULUS) % max(n, 1)


def times_drawn(n: int, reps: int, seed: int) -> np.ndarray:
    """reps x n: how often each event is drawn in each resample. Every resampled statistic is a function of these counts."""
    flat = draws(n, reps, seed) + np.arange(reps)[:, None] * n
    return np.bincount(flat.ravel(), minlength=reps * n).reshape(reps, n)


def resampled_medians(v: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Medians of the resamples: the middle places among the values in order, each repeated as often as it was drawn."""
    order = np.argsort(v, kind="stable")
    upto, n = np.cumsum(counts[:, order], axis=1), len(v)
    return (v[order][(upto > (n - 1) // 2).argmax(axis=1)] + v[order][(upto > n // 2).argmax(axis=1)]) / 2


def interval(values: np.ndarray, reps: int, seed: int, stat: str) -> tuple[float | None, float | None, float | None, int]:
    """(estimate, lo, hi, n) of the median or mean over events; no interval for fewer than two."""
    v = values[~np.isnan(values)]
    n = len(v)
    if not n:
        return None, None, None, 0
    estimate = float(np.median(v) if stat == "median" else v.mean())
    if n == 1:
        return estimate, None, None, 1
    counts = times_drawn(n, reps, seed)
    lo, hi = np.percentile(resampled_medians(v, counts) if stat == "median" else counts @ v / n, (2.5, 97.5))
    return estimate, float(lo), float(hi), n


def event_intervals(df: DataFrame, keys: list[str], event: str, value: str, reps: int, seed: int, stat: str = "median") -> DataFrame:
    """Per group the statistic over events with a percentile interval from resampled events: keys, estimate, lo, hi, n.

    A group holds one value per event, so its size is the number of events. NULL and NaN values are dropped first.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("__e")["__v"].to_numpy(float, na_value=np.nan)
        est, lo, hi, n = interval(v, reps, seed, stat)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], est, lo, hi, n]], columns=[*keys, "estimate", "lo", "hi", "n"])

    kept = df.select(*keys, F.col(event).cast("string").alias("__e"), F.col(value).cast("double").alias("__v"))
    schema = T.StructType([*[kept.schema[k] for k in keys], *T.StructType.fromDDL("estimate double, lo double, hi double, n bigint").fields])
    return kept.groupBy(*keys).applyInPandas(run, schema)


def curve_intervals(df: DataFrame, keys: list[str], event: str, at: str, value: str, reps: int, seed: int) -> DataFrame:
    """Per group and point the mean over events with a band from resampled events: keys, at, mean, lo, hi, n_events.

    n_events counts the events of the group, with or without a value at the point; fewer than two give no band. A group is a
    matrix of events by grid points.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="__e", columns="__at", values="__v", aggfunc="first", dropna=False).sort_index()
        x, n = m.to_numpy(float, na_value=np.nan), len(m)
        held = ~np.isnan(x)
        filled = np.where(held, x, 0.0)
        count = held.sum(0)
        mean = np.where(count > 0, filled.sum(0) / np.maximum(count, 1), np.nan)
        lo = hi = np.full(len(mean), np.nan)
        if n >= 2:
            weights = times_drawn(n, reps, seed).astype(float)
            boot = np.divide(weights @ filled, weights @ held, out=np.full((reps, x.shape[1]), np.nan), where=(weights @ held) > 0)
            some = ~np.all(np.isnan(boot), axis=0)
            lo, hi = np.full(len(mean), np.nan), np.full(len(mean), np.nan)
            if some.any():
                lo[some], hi[some] = np.nanquantile(boot[:, some], [0.025, 0.975], axis=0)
        out = pd.DataFrame({"at": m.columns.to_numpy(), "mean": mean, "lo": lo, "hi": hi, "n_events": n})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "at", "mean", "lo", "hi", "n_events"]].replace({np.nan: None})

    kept = df.select(*keys, F.col(event).cast("string").alias("__e"), F.col(at).alias("__at"), F.col(value).cast("double").alias("__v"))
    at_type = kept.schema["__at"].dataType.simpleString()
    schema = T.StructType([*[kept.schema[k] for k in keys], *T.StructType.fromDDL(f"at {at_type}, mean double, lo double, hi double, n_events bigint").fields])
    return kept.groupBy(*keys).applyInPandas(run, schema).withColumnRenamed("at", at)


def resampled_slopes(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slopes of the resamples that hold at least two different x, all from one product of the counts with the moments of each event."""
    n = len(x)
    u, v = x - x.mean(), y - y.mean()
    su, sv, suu, suv = (counts @ np.stack((u, v, u * u, u * v), axis=1)).T
    _, kind = np.unique(x, return_inverse=True)
    varied = ((counts @ np.eye(kind.max() + 1)[kind]) > 0).sum(axis=1) > 1
    return ((n * suv - su * sv)[varied]) / ((n * suu - su * su)[varied])


def slope_intervals(df: DataFrame, keys: list[str], event: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """Per group the percentile interval of the slope over resampled events: keys, boot_lo, boot_hi; NULL for fewer than three."""
    kept = df.select(*keys, F.col(event).cast("string").alias("__e"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    schema = T.StructType([*[kept.schema[k] for k in keys], *T.StructType.fromDDL("boot_lo double, boot_hi double").fields])

    def run(part: pa.Table) -> pa.Table:
        rows = part.select(["__e", "x", "y"]).sort_by("__e").drop_null()
        xs, ys = (rows.column(c).to_numpy().astype(float) for c in ("x", "y"))
        fine = ~(np.isnan(xs) | np.isnan(ys))
        slopes = resampled_slopes(xs[fine], ys[fine], times_drawn(int(fine.sum()), reps, seed)) if fine.sum() >= 3 else np.empty(0)
        ends = np.percentile(slopes, (2.5, 97.5)).tolist() if len(slopes) else [None, None]
        return pa.table({**{k: part.column(k).slice(0, 1) for k in keys}, "boot_lo": pa.array(ends[:1], pa.float64()), "boot_hi": pa.array(ends[1:], pa.float64())})

    return kept.groupBy(*keys).applyInArrow(run, schema)


def nearest_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Per group the value whose rank is nearest to q (n - 1), and n: keys, quantile, n; NULLs are left out.

    Values are counted before they are ranked, so a group is as large as its number of different values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(*keys))})
    at = F.rint(F.lit(q) * (F.col("n") - 1))
    return ranked.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*keys, F.col("v").alias("quantile"), "n")


def median_of(values: Column) -> Column:
    """Median of the elements of an array that are not NULL; NULL if there is none."""
    a = F.array_sort(F.array_compact(values))
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
