"""Queries of the training data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.shared import cut
from tidegrid.llm import leakage, nearest, packing, radix, sanitise
from tidegrid.sources.tables import table

PERCENTILES = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]
DEPTHS = ["base_depth_1", "base_depth_3", "base_depth_5", "base_depth_10"]
METRICS = ["recovery_50_s", "min_depth_pct"]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    requests, stages = table(spark, folder, "requests"), table(spark, folder, "stages")
    pairs = nearest.nearest_in_time(requests, stages, "request_id", "stage_id", "window_id", "window_id", "start_ns", "t0_ns", 1_200 * 10**9)
    return pairs.select("stage_id", "request_id")


def _depths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "baselines").select("baseline_id", "event_type", "instrument", "computed_on", *DEPTHS).distinct()


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "event_metrics").select("metric_id", "group_label", "instrument", "computed_on", *METRICS).distinct()


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of all metrics; group is the event type of a baseline or the label of an event metric."""
    rows = radix.ordered_values(_depths(spark, folder), ["event_type", "instrument"], DEPTHS)
    rows = rows.unionByName(radix.ordered_values(_metrics(spark, folder), ["group_label", "instrument"], METRICS))
    return radix.percentiles_of(rows, ["group", "instrument"], PERCENTILES).withColumn("value", F.round("value", 6))


def _day_histograms(spark: SparkSession, folder: str) -> DataFrame:
    depths = radix.day_histograms(_depths(spark, folder).withColumnRenamed("event_type", "group"), ["group", "instrument"], DEPTHS, "computed_on")
    metrics = radix.day_histograms(_metrics(spark, folder).withColumnRenamed("group_label", "group"), ["group", "instrument"], METRICS, "computed_on")
    return depths.unionByName(metrics)


def p6_day_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results per computed_on that can be combined: counts by the leading bits of the values."""
    return _day_histograms(spark, folder)


def p6_combined_days(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of the percentiles from the results per computed_on alone."""
    out = radix.combine(_day_histograms(spark, folder), ["group", "instrument"], PERCENTILES)
    return out.withColumns({c: F.round(c, 6) for c in ("least", "most")})


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text or piece for each plan; start and size are in tokens."""
    plans = table(spark, folder, "pack_plans").select("plan_id", "capacity_tokens", "across_repos").distinct().limit(101).collect()
    if len(plans) > 100:
        raise ValueError("more than 100 plans")
    tokens = cut(packing.count_tokens(table(spark, folder, "documents"), "doc_id", "text", ["repo"]))
    chosen = [(p["plan_id"], p["capacity_tokens"], None if p["across_repos"] else "repo") for p in sorted(plans)]
    return packing.fill_containers(tokens, "doc_id", "tokens", chosen)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan the containers, their tokens, the share of the capacity used, and the most that any placing could use.

    No placing needs fewer containers than the tokens of each group (all texts, or those of a repository) fill.
    """
    plans = table(spark, folder, "pack_plans").select("plan_id", "capacity_tokens", "across_repos").distinct()
    repos = table(spark, folder, "documents").select("doc_id", "repo").dropDuplicates(["doc_id"])
    placed = p7_containers(spark, folder).join(F.broadcast(plans), "plan_id").join(repos, "doc_id")
    groups = placed.groupBy("plan_id", F.when(~F.col("across_repos"), F.col("repo")).alias("grp")).agg(F.sum("size").alias("tokens"), F.first("capacity_tokens").alias("capacity"))
    least = groups.groupBy("plan_id").agg(F.sum(F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1))).alias("least_containers"))
    loads = placed.groupBy("plan_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("largest_piece"), F.first("capacity_tokens").alias("capacity"))
    used = [F.round(F.col("tokens") / (F.col(n) * F.col("capacity")), 4).alias(a) for n, a in (("containers", "used"), ("least_containers", "most_usable"))]
    return loads.join(least, "plan_id").select("plan_id", "containers", "least_containers", "tokens", "largest_piece", *used)


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any placing, per plan: texts placed, and how many containers or texts break a rule (0 of each kind)."""
    plans = table(spark, folder, "pack_plans").select("plan_id", "capacity_tokens", "across_repos").distinct()
    documents = table(spark, folder, "documents").filter("text is not null").select("doc_id", "repo").groupBy("doc_id").agg(F.first("repo").alias("repo"), F.count("*").alias("rows"))
    placed = p7_containers(spark, folder).join(documents, "doc_id").join(F.broadcast(plans), "plan_id")
    held = placed.groupBy("plan_id", "container_id").agg(F.sum("size").alias("load"), F.first("capacity_tokens").alias("capacity"), (F.count_distinct("repo") + F.max(F.col("repo").isNull().cast("int"))).alias("repos"), F.first("across_repos").alias("across"))
    rules = held.groupBy("plan_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), F.count_if(~F.col("across") & (F.col("repos") > 1)).alias("mixed"))
    texts = placed.groupBy("plan_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("size"), F.first("rows").alias("rows"), F.first("capacity_tokens").alias("capacity"), F.max(F.col("start") + F.col("size")).alias("end"))
    each = F.col("pieces") / F.col("rows")
    broken = texts.groupBy("plan_id").agg(
        F.sum("rows").alias("texts"), F.count_if((each > 1) & (F.col("size") / F.col("rows") <= F.col("capacity"))).alias("cut_needlessly"), F.count_if(F.col("size") != F.col("end") * F.col("rows")).alias("gaps")
    )
    return broken.join(rules, "plan_id").select("plan_id", "texts", "overfull", "mixed", "cut_needlessly", "gaps")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each affected document with the items it reveals."""
    return p8_found(spark, folder).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.personal_details(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "line_no", "kind").distinct()


def p9_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders in the place of personal details."""
    documents = table(spark, folder, "documents")
    found = sanitise.personal_details(documents, "doc_id", "text", parts=True)
    return sanitise.replace_details(documents.select("doc_id", "text"), found, "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p6_percentiles, p6_day_results, p6_combined_days, p7_containers, p7_fill, p7_invariants, p8_found, p8_documents, p9_found, p9_sanitised)}


def _percentile_sql(name: str, key: str, group: str, fields: list[str]) -> str:
    parts = []
    for f in fields:
        for p in PERCENTILES:
            parts.append(
                f"""SELECT {group} AS "group", instrument, '{f}' AS field, CAST({p} AS DOUBLE) AS percentile, count(*) AS n, round(quantile_cont({f}, {p / 100}), 6) AS value
                FROM (SELECT DISTINCT {key}, {group}, instrument, {f} FROM {name}) WHERE {f} IS NOT NULL AND NOT isnan({f}) GROUP BY ALL"""
            )
    return "\nUNION ALL\n".join(parts)


#: The leading 22 bits of the order-preserving integer of a double x, and the ends of such a bucket; infinities don't occur here.
_BUCKET = """CASE WHEN x = 0 THEN 0 WHEN x > 0 THEN b ELSE -b - 1 END"""
_BITS = """SELECT *, CAST((1023 + e) * 1024 + floor((abs(x) / pow(2.0, e) - 1) * 1024) AS BIGINT) AS b FROM (
    SELECT *, g + CASE WHEN pow(2.0, g) > abs(x) THEN -1 WHEN pow(2.0, g + 1) <= abs(x) THEN 1 ELSE 0 END AS e FROM (SELECT *, CAST(floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END)) AS INTEGER) AS g FROM {0}))"""
_EDGE = "pow(2.0, ({0}) // 1024 - 1023) * (1 + (({0}) % 1024) / 1024.0 + {1})"
_LAST = "(4398046511103 / 4503599627370496.0)"


def _values_sql() -> str:
    parts = [
        f"""SELECT {group} AS "group", instrument, computed_on, '{f}' AS field, CAST({f} AS DOUBLE) AS x FROM (SELECT DISTINCT {key}, {group}, instrument, computed_on, {f} FROM {name}) WHERE {f} IS NOT NULL AND NOT isnan({f})"""
        for name, key, group, fields in (("baselines", "baseline_id", "event_type", DEPTHS), ("event_metrics", "metric_id", "group_label", METRICS)) for f in fields
    ]
    return "vals AS (" + "\nUNION ALL ".join(parts) + f"), bits AS ({_BITS.format('vals')}), hist AS (SELECT \"group\", instrument, computed_on, field, {_BUCKET} AS bucket, count(*) AS n FROM bits GROUP BY ALL)"


def _combined_sql() -> str:
    wanted = "UNION ALL ".join(f"SELECT *, CAST({p} AS DOUBLE) AS percentile, CAST({f}({p / 100.0!r} * (total - 1)) AS BIGINT) AS rank FROM totals " for p in PERCENTILES for f in ("floor", "ceil"))
    k = '"group", instrument, field'
    low = f"CASE WHEN bucket = 0 THEN 0.0 WHEN bucket > 0 THEN {_EDGE.format('bucket', 0)} ELSE -({_EDGE.format('-bucket - 1', _LAST)}) END"
    high = f"CASE WHEN bucket >= 0 THEN {_EDGE.format('bucket', _LAST)} ELSE -({_EDGE.format('-bucket - 1', 0)}) END"
    return f"""WITH {_values_sql()}, h AS (SELECT {k}, bucket, sum(n) AS n FROM hist GROUP BY ALL), totals AS (SELECT {k}, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY ALL), wanted AS ({wanted}),
upto AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY bucket) AS upto FROM h), met AS (SELECT w.*, bucket FROM wanted w JOIN upto u ON u."group" IS NOT DISTINCT FROM w."group" AND u.instrument IS NOT DISTINCT FROM w.instrument AND u.field = w.field AND w.rank >= u.upto - u.n AND w.rank < u.upto)
SELECT {k}, percentile, any_value(total) AS n, round(min({low}), 6) AS least, round(max({high}), 6) AS most FROM met GROUP BY {k}, percentile"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_day_results": f"WITH {_values_sql()} SELECT * FROM hist",
        "p6_combined_days": _combined_sql(),
        "p7_invariants": """SELECT plan_id, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS mixed, CAST(0 AS BIGINT) AS cut_needlessly, CAST(0 AS BIGINT) AS gaps
FROM (SELECT DISTINCT plan_id FROM pack_plans)""",
        "p4_found": """WITH s AS (SELECT DISTINCT stage_id, window_id, t0_ns FROM stages WHERE t0_ns IS NOT NULL),
r AS (SELECT DISTINCT request_id, window_id, start_ns FROM requests WHERE start_ns IS NOT NULL)
SELECT stage_id, request_id FROM (SELECT stage_id, request_id, row_number() OVER (PARTITION BY request_id ORDER BY abs(t0_ns - start_ns), t0_ns, stage_id) AS k
    FROM r JOIN s USING (window_id) WHERE abs(t0_ns - start_ns) <= 1200000000000) WHERE k = 1""",
        "p6_percentiles": _percentile_sql("baselines", "baseline_id", "event_type", DEPTHS) + "\nUNION ALL\n" + _percentile_sql("event_metrics", "metric_id", "group_label", METRICS),
    }
