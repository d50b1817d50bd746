from tidegrid.plans import study


def test_bands_of_all_measures(spark, data):
    bands = study.QUERIES["curve_bands"](spark, data).toPandas()
    assert set(bands.measure) == {"depth_pct", "wide_spread", "updates_per_s", "trades_per_s"} and bands.groupby("measure").lo.count().min() > 0
    key = ["group", "instrument", "offset_s"]
    both = bands[bands.measure == "depth_pct"].merge(study.QUERIES["bootstrap_curve_ci"](spark, data).toPandas(), on=key, suffixes=("", "_one"))
    assert len(both) == (bands.measure == "depth_pct").sum() and all(both[c].fillna(-1).eq(both[f"{c}_one"].fillna(-1)).all() for c in ("mean", "lo", "hi"))


def test_ranking_has_its_intervals(spark, data):
    wide, plain = study.QUERIES["first_mover_intervals"](spark, data), study.QUERIES["first_mover_ranking"](spark, data)
    assert set(wide.columns) == set(plain.columns) | {"lo", "hi", "diff_lo", "diff_hi"}
    rows = wide.toPandas()
    moved = rows[rows.lo.notna()]
    assert len(rows) == plain.count() and len(moved) and (moved.lo <= moved.median_first_move_ms).all() and (moved.median_first_move_ms <= moved.hi).all()
