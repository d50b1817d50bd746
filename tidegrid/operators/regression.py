"""Reaction regressions of returns on surprises, with robust errors, false discovery control and sign checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import Study
from tidegrid.functions.shared import cut
from tidegrid.operators.stats import benjamini_hochberg, normal_p, ols_hc3, slope_intervals

TESTS = ["event_type", "stage", "instrument", "horizon_s", "unit"]
#: The stage each event type is studied at, approximate durations, textbook directions for a positive surprise.
STAGE_FOR = {"CPI": "release", "NFP": "release", "FOMC": "statement"}
DURATION = {"ZT": 1.9, "ZF": 4.0, "ZN": 6.3, "ZB": 11.5}
EXPECTED = {
    "CPI": {"ZT": -1, "ZF": -1, "ZN": -1, "ZB": -1, "ES": -1, "GC": -1, "CL": 0, "6E": -1, "6J": -1},
    "NFP": {"ZT": -1, "ZF": -1, "ZN": -1, "ZB": -1, "ES": 0, "GC": -1, "CL": 0, "6E": -1, "6J": -1},
    "FOMC": {"ZT": -1, "ZF": -1, "ZN": -1, "ZB": -1, "ES": -1, "GC": -1, "CL": 0, "6E": -1, "6J": -1},
}


def mapped(values: dict, key: Column, kind: str) -> Column:
    """The value of a small literal map, NULL for keys it lacks."""
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[key].cast(kind)


def implied_surprises(coarse: DataFrame, study: Study) -> DataFrame:
    """Market-implied surprise of each FOMC statement: minus the move of one instrument over the window, per standard deviation."""
    lo, hi = (s * 1000 for s in study.surprise_window_s)
    d = coarse.filter((F.col("event_type") == "FOMC") & (F.col("stage") == "statement") & (F.col("instrument") == study.surprise_instrument))
    move = F.max(F.when(F.col("offset_ms") == hi, F.col("mid"))) - F.max(F.when(F.col("offset_ms") == lo, F.col("mid")))
    w = d.filter(F.col("offset_ms").isin(lo, hi)).groupBy(F.col("window_id").alias("event_id"), "event_type").agg(move.alias("move_ticks"))
    sd = w.agg(F.stddev_samp("move_ticks").alias("sd"))
    z = F.when(F.col("sd") > 0, -F.col("move_ticks") / F.col("sd"))
    return w.join(F.broadcast(sd)).select("event_id", "event_type", z.alias("z"), "move_ticks")


def returns_at_horizons(coarse: DataFrame, study: Study, durations: dict[str, float] = DURATION) -> DataFrame:
    """Moves from before t0 to each horizon, in ticks, basis points of the mid before, and approximate basis points of yield."""
    pre = coarse.filter(F.col("offset_ms") == study.pre_s * 1000).select("window_id", "stage", "instrument", F.col("mid").alias("mid_pre"))
    at = coarse.filter((F.col("event_type") != "CONTROL") & F.col("offset_ms").isin([h * 1000 for h in study.horizons_s]))
    d = at.join(pre, ["window_id", "stage", "instrument"], "left").withColumn("ret_bps", F.try_divide(1e4 * F.col("mid_move"), F.col("mid_pre")))
    return d.select(
        "window_id", "event_type", "stage", "instrument", F.floor(F.col("offset_ms") / 1000).alias("horizon_s"), F.col("mid_move").alias("ret_ticks"), "ret_bps",
        F.try_divide(-F.col("ret_bps"), mapped(durations, F.col("instrument"), "double")).alias("approx_dyield_bp"),
    )


def tests(returns: DataFrame, surprises: DataFrame) -> DataFrame:
    """Long form of the regressions: TESTS, window_id, z, ret, and z split into its positive and negative part."""
    z = surprises.select(F.col("event_id").alias("window_id"), "z").filter("z is not null")
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("ret")) for u in ("ret_ticks", "ret_bps")])
    d = returns.filter(F.col("stage") == mapped(STAGE_FOR, F.col("event_type"), "string")).join(z, "window_id")
    d = d.select("window_id", "event_type", "stage", "instrument", "horizon_s", "z", F.explode(units).alias("u")).select("*", "u.*").drop("u")
    return d.withColumns({"z_pos": F.greatest("z", F.lit(0.0)), "z_neg": F.least("z", F.lit(0.0))})


def fits(t: DataFrame) -> DataFrame:
    """One regression per test, and the two one-sided ones, each over all events, where at least three lie on that side.

    All three run as one, the side being part of the key.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("x")) for s, c in (("all", "z"), ("pos", "z_pos"), ("neg", "z_neg"))])
    long = t.select(*TESTS, "ret", "z", F.explode(sides).alias("s")).select(*TESTS, "ret", "z", "s.*")
    fit = ols_hc3(long, [*TESTS, "side"], "x", "ret")
    counts = t.groupBy(*TESTS).agg(F.count_if(F.col("z") > 0).alias("n_pos"), F.count_if(F.col("z") < 0).alias("n_neg"))
    own = {c: F.max(F.when(F.col("side") == "all", F.col(c))) for c in ("n_events", "beta", "se_hc3", "t", "r2")}
    one_sided = {f"beta_{s}": F.max(F.when(F.col("side") == s, F.col("beta"))) for s in ("pos", "neg")}
    out = fit.groupBy(*TESTS).agg(*[e.alias(c) for c, e in {**own, **one_sided}.items()]).join(counts, TESTS)
    return out.withColumns({f"beta_{s}": F.when(F.col(f"n_{s}") >= 3, F.col(f"beta_{s}")) for s in ("pos", "neg")})


def sign_check(expected: Column, beta: Column, survives: Column) -> Column:
    return (
        F.when(expected == 0, "no expectation").when(F.signum(beta) == expected, "as expected").when(survives, "WRONG SIGN: investigate").otherwise("unexpected but not significant")
    )


def judged(fitted: DataFrame, study: Study, expected: dict = EXPECTED) -> DataFrame:
    """Fits with p, false discovery rates over the non-mechanical tick tests, and the check of their signs."""
    signs = {f"{t}/{i}": s for t, row in expected.items() for i, s in row.items()}
    mechanical = (F.col("event_type") == "FOMC") & (F.col("instrument") == study.surprise_instrument)
    d = fitted.withColumns({
        "p": normal_p("t"), "mechanical": mechanical, "expected_sign": F.coalesce(mapped(signs, F.concat_ws("/", "event_type", "instrument"), "int"), F.lit(0)),
    })
    d = d.withColumn("main_p", F.when((F.col("unit") == "ret_ticks") & ~F.col("mechanical"), F.col("p")))
    d = benjamini_hochberg(d, "main_p", study.fdr_alpha).drop("main_p")
    return d.withColumn("sign_check", sign_check(F.col("expected_sign"), F.col("beta"), F.col("survives_fdr")))


def regressions(returns: DataFrame, surprises: DataFrame, study: Study, expected: dict = EXPECTED) -> DataFrame:
    """The whole table: fits, bootstrap intervals of the slope, p, q and sign check."""
    t = cut(tests(returns, surprises))  # a few rows per event, used three times
    boot = slope_intervals(t, TESTS, "window_id", "z", "ret", study.reps, study.seed + 2)
    return judged(fits(t).join(boot, TESTS), study, expected)


def continuation(coarse: DataFrame, study: Study) -> DataFrame:
    """Does the first move predict the move from there on? One regression per instrument and later horizon."""
    first, *later = (s * 1000 for s in study.continuation_s)
    d = coarse.filter((F.col("event_type") != "CONTROL") & (F.col("stage") == mapped(STAGE_FOR, F.col("event_type"), "string")))
    at = {m: F.max(F.when(F.col("offset_ms") == m, F.col("mid_move"))) for m in (first, *later)}
    wide = d.filter(F.col("offset_ms").isin([first, *later])).groupBy("window_id", "event_type", "instrument").agg(*[e.alias(f"m{m}") for m, e in at.items()])
    rows = F.array(*[F.struct(F.lit(f"+{first // 60000} min to +{m // 60000} min").alias("window"), (F.col(f"m{m}") - F.col(f"m{first}")).alias("after")) for m in later])
    long = wide.select("event_type", "instrument", F.col(f"m{first}").alias("first"), F.explode(rows).alias("r")).select("event_type", "instrument", "first", "r.*")
    fit = ols_hc3(long, ["event_type", "instrument", "window"], "first", "after")
    reading = F.when(F.col("beta") > 0, "continuation").when(F.col("beta") < 0, "reversal").otherwise("none")
    return fit.select("event_type", "instrument", "window", "beta", "t", normal_p("t").alias("p"), "n_events", reading.alias("reading"))


def standardised(df: DataFrame, expanding: bool = False, order: str = "release_date", least: float = 1e-9) -> DataFrame:
    """`df` (variable, actual, consensus, release_date) with surprise and z, its size per standard deviation of the variable.

    expanding: only strictly earlier entries of the variable scale an entry, of which there must be two. Ties in the order
    are broken by event_id. A scale of at most `least` gives NULL.
    """
    d = df.withColumn("surprise", F.round(F.col("actual") - F.col("consensus"), 10))
    if expanding:
        w = Window.partitionBy("variable").orderBy(order, "event_id").rowsBetween(Window.unboundedPreceding, -1)
        sd, n = F.stddev_samp("surprise").over(w), F.count("surprise").over(w)
        return d.withColumn("z", F.when((n >= 2) & (sd > least), F.col("surprise") / sd))
    scale = d.groupBy("variable").agg(F.stddev_samp("surprise").alias("__sd"))
    return d.join(scale, "variable", "left").withColumn("z", F.when(F.col("__sd") > least, F.col("surprise") / F.col("__sd"))).drop("__sd")


def raw_surprises(entries: DataFrame) -> DataFrame:
    """Unscaled surprises of the primary variable of each event: event_id, event_type, release_date, surprise, z (per standard deviation)."""
    from tidegrid.operators.calendar import VARIABLES

    primary = entries.filter(F.col("variable").isin([k for k, v in VARIABLES.items() if v[2]]) & F.col("actual").isNotNull() & F.col("consensus").isNotNull())
    return standardised(primary).select("event_id", "event_type", "release_date", "surprise", "z")


def surprise_summary(z: DataFrame) -> DataFrame:
    return z.groupBy("event_type", "variable").agg(
        F.count("*").alias("events"), F.avg("surprise").alias("mean_surprise"), F.stddev_samp("surprise").alias("sd_surprise"), F.min("surprise").alias("min_surprise"),
        F.max("surprise").alias("max_surprise"), F.count_if(F.abs("z") > 1).alias("abs_z_over_1"),
    )


def robustness(table: DataFrame, least_events: int) -> DataFrame:
    """The tick tests with their label: robust if they survive with enough events, else suggestive."""
    main = table.filter((F.col("unit") == "ret_ticks") & ~F.col("mechanical"))
    return main.withColumn("label", F.when(F.col("survives_fdr") & (F.col("n_events") >= least_events), "robust").otherwise("suggestive"))
