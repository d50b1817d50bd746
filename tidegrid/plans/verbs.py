"""Queries of the general verbs on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions.previous import running
from tidegrid.operators import costplan, stats
from tidegrid.plans.study import ols_sql, rounded
from tidegrid.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(lambda name: table(spark, folder, name)))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands, round(l_extendedprice * (1 - l_discount), 6) AS net, 'tape' AS source FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'")
def select_filter(t):
    d = t("lineitem").filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").startswith("F"))
    return d.select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 1000).alias("thousands"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.lit("tape").alias("source"))


@query("""SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root, CAST(sign(c_acctbal) AS DOUBLE) AS way, greatest(c_acctbal, 0.0) AS gain, round_even(c_acctbal, 0) AS nearest, round(pow(2.0, -abs(c_acctbal) / 1000), 6) AS decay,
least(greatest(c_acctbal, -100.0), 100.0) AS clipped, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'fair' ELSE 'low' END AS grade, CAST(floor(floor(c_acctbal) / 1000) AS BIGINT) AS band FROM customer WHERE c_acctbal IS NOT NULL""")
def scalar_math(t):
    b = F.col("c_acctbal")
    return t("customer").filter(b.isNotNull()).select(
        "c_custkey", F.abs(b).alias("size"), F.sqrt(F.abs(b)).alias("root"), F.signum(b).alias("way"), F.greatest(b, F.lit(0.0)).alias("gain"), F.rint(b).alias("nearest"), F.pow(F.lit(2.0), -F.abs(b) / 1000).alias("decay"),
        F.least(F.greatest(b, F.lit(-100.0)), F.lit(100.0)).alias("clipped"), F.when(b > 5000, "high").when(b > 0, "fair").otherwise("low").alias("grade"), F.floor(F.floor(b) / 1000).alias("band"),
    )


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def inner_join(t):
    o = t("orders").filter("o_totalprice > 100000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def left_join(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))  # summed before the join, so a hot customer is one row
    return t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.round("s", 2).alias("spent"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_join(t):
    return t("part").join(t("lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT r_name, s.segment, q.qty FROM region, (SELECT DISTINCT c_mktsegment AS segment FROM customer) s, (VALUES (1), (5)) q(qty)")
def cross_join(t):
    """Two short dimensions and a parameter list: at most a few hundred rows a side."""
    s = t("customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    pairs = t("region").select("r_name").join(s)
    return pairs.select("r_name", "segment", F.explode(F.array(F.lit(1), F.lit(5))).alias("qty"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, round(epoch(l_shipdate - ref) / 86400, 6) AS days_after FROM (SELECT *, max(CASE WHEN l_linenumber = 1 THEN l_shipdate END) OVER (PARTITION BY l_orderkey) AS ref FROM lineitem) WHERE ref IS NOT NULL""")
def self_join_reference(t):
    """Each line against the first line of its order, by a conditional maximum instead of a self-join."""
    ref = F.max(F.when(F.col("l_linenumber") == 1, F.col("l_shipdate"))).over(Window.partitionBy("l_orderkey"))
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", ref.alias("ref")).filter("ref is not null")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("ref").cast("timestamp"))
    return d.select("l_orderkey", "l_linenumber", "l_shipdate", (us / 86_400_000_000).alias("days_after"))


@query("SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM orders")
def theta_join_earlier(t):
    """All earlier rows of a key, summed by a frame that ends just before the row, so that no pairs are formed."""
    d = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    d = running(d, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"n": F.lit(1), "s": F.col("o_totalprice")}, before=True)
    return d.select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("earlier"), (F.col("s") / F.col("n")).alias("mean_before"))


@query("SELECT c_nationkey AS nationkey, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def union_all(t):
    c = t("customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    return c.unionByName(t("supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind")))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t):
    return t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY ALL")
def dedupe_keep_last(t):
    return t("orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey", "m.o_orderdate")


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_difference(t):
    return t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).subtract(t("supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nationkey")))


@query("SELECT DISTINCT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return t("customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("nationkey")).intersect(t("supplier").select(F.col("s_nationkey").alias("nationkey")))


@query("""SELECT o_custkey, min(o_totalprice) FILTER (o_orderstatus = 'F') AS "F", min(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", min(o_totalprice) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY ALL""")
def pivot_first(t):
    return t("orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.min("o_totalprice"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price, round(stddev_samp(l_discount), 6) AS sd_discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
round(median(l_extendedprice), 6) AS median_price, count(*) FILTER (l_discount > 0.05) AS discounted, round(avg(CASE WHEN l_tax > 0 THEN 1.0 ELSE 0.0 END), 6) AS taxed_share FROM lineitem GROUP BY ALL""")
def group_multi_agg(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.stddev_samp("l_discount").alias("sd_discount"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.median("l_extendedprice").alias("median_price"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.avg((F.col("l_tax") > 0).cast("int")).alias("taxed_share"),
    )


@query("SELECT p_brand, min(p_retailprice) AS least, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS cheapest FROM part GROUP BY ALL")
def argmin_by(t):
    return t("part").groupBy("p_brand").agg(F.min("p_retailprice").alias("least"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))


@query("SELECT o_orderpriority, max(o_totalprice) AS most, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS dearest FROM orders GROUP BY ALL")
def argmax_by(t):
    return t("orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("most"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"))


@query("SELECT l_shipdate, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_orderkey, l_suppkey)) AS pairs FROM lineitem GROUP BY ALL")
def count_distinct(t):
    return t("lineitem").groupBy("l_shipdate").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.struct("l_orderkey", "l_suppkey")).alias("pairs"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY place <= 5")
def topk_per_group(t):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("place")).filter("place <= 5")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def multi_key_sort_limit(t):
    return t("customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.asc_nulls_last("c_mktsegment"), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(50)


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 6) AS change, lead(o_orderkey) OVER w AS next_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_diff(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("change"), F.lead("o_orderkey").over(w).alias("next_order"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def running_sum(t):
    d = running(t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"running": F.col("o_totalprice")})
    return d.select("o_custkey", "o_orderkey", F.round("running", 2).alias("running"))


@query("""SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS day_events FROM events""")
def range_window(t):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_399_999_999, 0)
    return t("events").select("event_id", "user_id", "ts", F.count("*").over(w).alias("day_events"))


@query("""SELECT l_suppkey, max(gap_days) AS max_gap_days FROM (SELECT l_suppkey, date_diff('day', lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate), CAST(l_shipdate AS DATE)) AS gap_days FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem)) GROUP BY ALL""")
def max_gap(t):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate")
    days = t("lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("l_shipdate")).distinct()
    return days.withColumn("g", F.datediff("l_shipdate", F.lag("l_shipdate").over(w))).groupBy("l_suppkey").agg(F.max("g").cast("long").alias("max_gap_days"))


@query("""SELECT c_nationkey, v AS q99, n FROM (SELECT c_nationkey, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WHERE c_acctbal IS NOT NULL) WHERE r = CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1""")
def quantile_nearest(t):
    return stats.nearest_quantile(t("customer"), ["c_nationkey"], "c_acctbal", 0.99).withColumnRenamed("quantile", "q99")


@query(f"""WITH {ols_sql('lineitem', ['l_returnflag', 'l_linenumber'], 'l_quantity', 'l_extendedprice')} SELECT l_returnflag, l_linenumber, n_events, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(se_hc3, 6) AS se_hc3, round(t, 6) AS t, round(r2, 6) AS r2 FROM o""")
def ols_hc3_lines(t):
    return stats.ols_hc3(t("lineitem"), ["l_returnflag", "l_linenumber"], "l_quantity", "l_extendedprice")


@query("""WITH p AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey * 7919 % 10007) / 10007.0 * CASE WHEN c_custkey % 5 = 0 THEN 0.001 ELSE 1 END END AS p FROM customer),
r AS (SELECT *, p * count(*) OVER (PARTITION BY c_nationkey) / count(*) OVER (PARTITION BY c_nationkey ORDER BY p) AS a FROM p WHERE p IS NOT NULL),
q AS (SELECT *, least(min(a) OVER (PARTITION BY c_nationkey ORDER BY p DESC), 1.0) AS q_bh FROM r)
SELECT c_custkey, c_nationkey, round(p, 6) AS p, round(q_bh, 6) AS q_bh, q_bh <= 0.05 AS survives_fdr FROM q UNION ALL SELECT c_custkey, c_nationkey, NULL, NULL, false FROM p WHERE p IS NULL""")
def bh_fdr(t):
    p = F.when(F.col("c_custkey") % 17 != 0, F.col("c_custkey") * 7919 % 10007 / F.lit(10007.0) * F.when(F.col("c_custkey") % 5 == 0, 0.001).otherwise(1.0))
    return stats.benjamini_hochberg(t("customer").select("c_custkey", "c_nationkey", p.alias("p")), "p", 0.05, ["c_nationkey"])


@query("SELECT o_custkey, o_orderstatus, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def request_dedupe(t):
    return costplan.first_of(t("orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderstatus"], "o_orderdate").drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spent, round(sum(o_totalprice) OVER w, 2) <= 500000 AS allowed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def budget_running_sum(t):
    d = costplan.within_budget(t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000)
    return d.select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"), (F.round("spent", 2) <= 500_000).alias("allowed"))


@query("""SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END) // 2 AS halved, CAST(sum(n - 1) AS BIGINT) AS surplus, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM (SELECT * FROM requests) GROUP BY request_id, instrument, feed_schema, window_id, start_ns, end_ns, symbol, requested_at)""")
def duplicate_rows(t):
    r = t("requests")
    n = r.groupBy(*r.columns).agg(F.count("*").alias("n"))
    return n.agg(F.expr("sum(if(n > 1, n, 0)) div 2").alias("halved"), F.sum(F.col("n") - 1).alias("surplus"), F.sum("n").alias("rows"))


SQL["duplicate_rows"] = SQL["duplicate_rows"].replace("// 2 AS halved", "// 2 AS halved").replace("SELECT sum(CASE", "SELECT CAST(sum(CASE", 1).replace("// 2 AS halved", "AS BIGINT) // 2 AS halved", 1)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
