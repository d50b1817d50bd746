"""Text of results: sentences, tables, the report file and a block inside another file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<!-- results:start -->", "<!-- results:end -->"
#: Result tables are short; longer ones are an error rather than cut.
MOST_ROWS = 10_000


def rows_of(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report table has at most {MOST_ROWS} rows")
    return rows


def markdown_table(df: DataFrame) -> str:
    def text(v) -> str:
        return "n/a" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows_of(df)]) + "\n"


def liquidity_sentences(compared: DataFrame, instrument: str) -> DataFrame:
    """One sentence per event group on the least depth, beside its controls: group, sentence."""
    d = compared.filter((F.col("instrument") == instrument) & (F.col("metric") == "min_depth_pct"))
    n = F.lit("n/a")
    return d.select("group", F.format_string(
        "%s, %s: depth falls to a median of %s %% of its baseline around the release (%d events; controls %s %%, %d days).", "group", "instrument",
        F.coalesce(F.format_string("%.0f", "estimate"), n), "n", F.coalesce(F.format_string("%.0f", "control_estimate"), n), F.coalesce("n_control", F.lit(0)),
    ).alias("sentence"))


def _number(column: str, form: str = "%.1f"):
    return F.coalesce(F.format_string(form, column), F.lit("n/a"))


def reaction_sentences(ranking: DataFrame) -> DataFrame:
    """Which instrument moves first after each kind of release, and which next: event_type, stage, sentence."""
    order = F.struct(F.col("median_first_move_ms").isNull(), "median_first_move_ms", "instrument")
    both = ranking.groupBy("event_type", "stage").agg(F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), "instrument", "median_first_move_ms", "events_with_move"))), 1, 2).alias("top"))
    d = both.select("event_type", "stage", F.col("top")[0].alias("a"), F.get("top", 1).alias("b")).filter("a.median_first_move_ms is not null")
    second = F.when(F.col("b.median_first_move_ms").isNotNull(), F.format_string(", then %s after %.1f ms", "b.instrument", "b.median_first_move_ms")).otherwise("")
    return d.select("event_type", "stage", F.concat(F.format_string("%s %s: %s moves first, in the median %.1f ms after the release (%d events)", "event_type", "stage", "a.instrument", "a.median_first_move_ms", "a.events_with_move"), second, F.lit(".")).alias("sentence"))


def regression_sentences(table: DataFrame, horizon_s: int | None = None) -> DataFrame:
    """The slope of each test in ticks that survives the false discovery control, or that there is none: sentence."""
    main = table.filter((F.col("unit") == "ret_ticks") & ~F.col("mechanical"))
    main = main if horizon_s is None else main.filter(F.col("horizon_s") == horizon_s)
    kept = main.filter("survives_fdr").orderBy("event_type", "instrument", "horizon_s")
    one = F.format_string("%s, %s, %d s after: %s ticks per standard deviation of surprise (95 %% interval %s to %s, %d events): %s.", "event_type", "instrument", "horizon_s", _number("beta", "%+.2f"), _number("boot_lo", "%+.2f"), _number("boot_hi", "%+.2f"), "n_events", "sign_check")
    none = main.agg(F.count("*").alias("tests"), F.count_if("survives_fdr").alias("kept")).select(F.format_string("%d of %d tests survive the control of false discoveries.", "kept", "tests").alias("sentence"))
    return none.unionByName(kept.select(one.alias("sentence")))


def execution_sentences(normal: DataFrame) -> DataFrame:
    """What trading costs after each release, and when it is normal again: sentence."""
    again = F.coalesce(F.format_string("normal again after %.0f s", "seconds_to_normal"), F.lit("not normal again within the window"))
    text = F.format_string("%s, %s, %d lots: %s ticks more than normal (%s) in the first seconds, %s.", "group", "instrument", "qty", _number("extra_first_5s_ticks", "%+.2f"), _number("normal_ticks", "%.2f"), again)
    return normal.orderBy("group", "instrument", "qty").select(text.alias("sentence"))


def strategy_sentences(summary: DataFrame) -> DataFrame:
    """The best rule of each event type, net of costs: sentence."""
    order = F.struct(-F.col("mean_net_ticks"), "instrument", "delay_s", "exit_s")
    best = summary.filter("mean_net_ticks is not null").groupBy("event_type").agg(F.min_by(F.struct("instrument", "delay_s", "exit_s", "mean_net_ticks", "ci_lo", "ci_hi", "trades"), order).alias("b")).select("event_type", "b.*")
    text = F.format_string("%s: the best of the tested rules trades %s from %d s to %d s and makes %s ticks a trade after costs (95 %% interval %s to %s, %d trades).", "event_type", "instrument", "delay_s", "exit_s", _number("mean_net_ticks", "%+.2f"), _number("ci_lo", "%+.2f"), _number("ci_hi", "%+.2f"), "trades")
    return best.orderBy("event_type").select(text.alias("sentence"))


def validation_note(validation: DataFrame) -> str:
    """How many events show a spike of movement at their release time."""
    r = validation.agg(F.count("*").alias("n"), F.count_if("confirmed").alias("k")).first()
    return f"{r['k']} of {r['n']} events are confirmed by a spike of movement at the release time."


def write_report(path: str, sections: dict[str, str], synthetic: bool) -> None:
    """A Markdown report; results of synthetic books say so at the top."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    banner = "> Made from synthetic books: no market result.\n\n" if synthetic else ""
    with open(path, "w") as f:
        f.write("# Report\n\n" + banner + "\n".join(f"## {t}\n\n{body.strip() or '_Not run yet._'}\n" for t, body in sections.items()))


def replace_block(path: str, body: str, synthetic: bool) -> None:
    """Put `body` between the markers of a file; refused for synthetic results."""
    if synthetic:
        raise ValueError("synthetic results don't go into this file")
    with open(path) as f:
        text = f.read()
    if START not in text or END not in text:
        raise ValueError("the file has no markers for results")
    head, tail = text.split(START)[0], text.split(END)[1]
    with open(path, "w") as f:
        f.write(f"{head}{START}\n{body.strip()}\n{END}{tail}")
