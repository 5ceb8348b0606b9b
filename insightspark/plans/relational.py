"""Filters, joins, aggregates, samples, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions import scalars as H
from insightspark.functions.columns import bucketize, ratio
from insightspark.operators import relational as R
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))


# -- B filters -------------------------------------------------------------

@query("b1_filter", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE ts >= DATE '2024-01-30' - 7 AND ts < DATE '2024-01-30' AND event_type IN ('purchase', 'click') GROUP BY 1""")
def b1(t):
    df = R.recent_window(t.events, "ts", "2024-01-30", 7, F.col("event_type").isin("purchase", "click"))
    return df.groupBy("event_type").agg(N().alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("b2_population_flag", """
WITH f AS (
 SELECT o_custkey, o_totalprice,
  CASE WHEN c.c_acctbal < 0 OR n.n_regionkey = 0 THEN 'suspicious' ELSE 'rest' END AS population
 FROM orders LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey),
a AS (SELECT count(DISTINCT o_custkey) AS n_all, count(DISTINCT CASE WHEN population='rest' THEN o_custkey END) AS n_clean,
 count(DISTINCT CASE WHEN population<>'rest' THEN o_custkey END) AS n_bad, count(*) AS r_all,
 count(CASE WHEN population='rest' THEN 1 END) AS r_clean, sum(o_totalprice) AS v_all,
 sum(CASE WHEN population='rest' THEN o_totalprice END) AS v_clean FROM f)
SELECT 'all' AS "view", n_all AS users, r_all AS n_rows, round(v_all, 2) AS amount, round(100.0*n_bad/n_all, 4) AS contamination_pct FROM a
UNION ALL SELECT 'clean', n_clean, r_clean, round(v_clean, 2), round(100.0*n_bad/n_all, 4) FROM a""")
def b2(t):
    facts = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    bad_users = t.customer.where("c_acctbal < 0").select("c_custkey")
    bad_sources = t.nation.where("n_regionkey = 0").select("n_nationkey")
    flagged = R.flag_population(facts, "o_custkey", bad_users, "c_nationkey", bad_sources)
    out = R.population_views(flagged, "o_custkey", "o_totalprice")
    return out.withColumn("amount", F.round("amount", 2))


@query("b3_exclusion_stack", """
SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'MACHINERY' THEN 'segment'
 WHEN c_nationkey % 5 = 0 THEN 'nation' END AS excluded_by, count(*) AS n FROM customer GROUP BY 1""")
def b3(t):
    df = R.exclusion_stack(t.customer, {
        "debt": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "MACHINERY", "nation": F.col("c_nationkey") % 5 == 0})
    return df.groupBy("excluded_by").agg(N().alias("n"))


@query("b4_not_in_subquery", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40) GROUP BY 1""")
def b4(t):
    banned = t.events.where("event_type = 'error' AND value > 40").select("user_id").distinct()
    return R.not_in(t.events, "user_id", banned).groupBy("event_type").agg(
        N().alias("n"), F.count_distinct("user_id").alias("users"))


@query("b5_bucketize", """
WITH c AS (SELECT c_custkey, count(o_orderkey) AS k, sum(o_totalprice) AS s
 FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT CASE WHEN s IS NULL THEN 'a. none' WHEN s <= 500000 THEN 'b. <=500k' WHEN s <= 2000000 THEN 'c. 500k-2m'
  ELSE 'd. 2m+' END AS spend_bucket,
 CASE WHEN k = 0 THEN 'a. zero' WHEN k < 5 THEN 'b. 1-4' WHEN k < 10 THEN 'c. 5-9' ELSE 'd. 10+' END AS order_bucket,
 count(*) AS n FROM c GROUP BY 1, 2""")
def b5(t):
    per = t.orders.groupBy("o_custkey").agg(N().alias("k"), F.sum("o_totalprice").alias("s"))
    c = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.coalesce("k", F.lit(0)).alias("k"), "s")
    return c.groupBy(
        bucketize("s", [500000, 2000000], ["b. <=500k", "c. 500k-2m", "d. 2m+"], null_label="a. none").alias("spend_bucket"),
        bucketize("k", [5, 10], ["b. 1-4", "c. 5-9", "d. 10+"], zero_label="a. zero", right=False).alias("order_bucket"),
    ).agg(N().alias("n"))


@query("b6_session_end_reason", """
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type='error' THEN 1 ELSE 0 END) AS a,
 max(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1, 2)
SELECT CASE WHEN a=1 AND b=1 THEN 'Both error & purchase' WHEN a=1 THEN 'error' WHEN b=1 THEN 'purchase' ELSE 'Other' END AS reason,
 count(*) AS n FROM g GROUP BY 1""")
def b6(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    r = R.two_flag_reason(e, ["user_id", "day"], F.col("event_type") == "error", F.col("event_type") == "purchase",
                          "error", "purchase")
    return r.groupBy("reason").agg(N().alias("n"))


@query("b7_like_classify", """
SELECT concat(CASE WHEN p_name LIKE '%ring%' THEN 'Ring' WHEN p_name LIKE '%widget%' THEN 'Widget' ELSE 'Other' END, '-',
 CASE WHEN p_brand LIKE '%#1%' THEN '1D' WHEN p_brand LIKE '%#2%' THEN '2D' ELSE '_' END) AS class, count(*) AS n
FROM part WHERE (p_type LIKE 'E%' OR p_type LIKE 'S%' OR p_type LIKE 'P%') AND p_type NOT LIKE '%SMALL%' GROUP BY 1""")
def b7(t):
    keep = t.part.where(R.like_filter("p_type", ["E%", "S%", "P%"], ["%SMALL%"]))
    label = F.concat(R.like_classify("p_name", {"Ring": "%ring%", "Widget": "%widget%"}), F.lit("-"),
                     R.like_classify("p_brand", {"1D": "%#1%", "2D": "%#2%"}, "_"))
    return keep.groupBy(label.alias("class")).agg(N().alias("n"))


@query("b8_config_validity", """
SELECT CASE WHEN (o_custkey % 2 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
  OR (o_custkey % 2 <> 0 AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) THEN 'Valid Config' ELSE 'Bad Config' END AS config_type,
 count(*) AS n FROM orders GROUP BY 1""")
def b8(t):
    df = t.orders.withColumn("variant", F.when(F.col("o_custkey") % 2 == 0, "Control").otherwise("Variant"))
    kind = R.config_validity("variant", "o_orderpriority", "Control", ["1-URGENT", "2-HIGH"],
                             ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return df.groupBy(kind.alias("config_type")).agg(N().alias("n"))


@query("b9_role_classify", """
WITH g AS (SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS n_items,
 sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS contribution FROM lineitem GROUP BY 1)
SELECT l_suppkey, n_items, round(contribution, 6) AS contribution,
 CASE WHEN n_items >= 3 AND contribution > 0.6 THEN 'Carry' ELSE 'Other' END AS role FROM g""")
def b9(t):
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    return R.role_classify(t.lineitem, ["l_suppkey"], "l_partkey", kept, "l_quantity", F.col("l_quantity") > 40)


@query("b10_lifecycle_segments", """
WITH u AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l FROM orders GROUP BY 1),
d AS (SELECT DATE '2001-08-02' - f AS tenure_days, DATE '2001-08-02' - l AS inactive_days FROM u)
SELECT CASE WHEN tenure_days <= 6 THEN 'D0-6' WHEN tenure_days <= 14 THEN 'D7-14' WHEN tenure_days <= 30 THEN 'D15-30'
 WHEN tenure_days <= 90 THEN 'D31-90' WHEN tenure_days <= 180 THEN 'D91-180' WHEN tenure_days <= 365 THEN 'D181-365' ELSE 'D365+' END AS tenure,
 CASE WHEN inactive_days <= 5 THEN 'active' WHEN inactive_days <= 13 THEN 'early' WHEN inactive_days <= 20 THEN 'mid' ELSE 'late' END AS inactivity,
 count(*) AS n FROM d GROUP BY 1, 2""")
def b10(t):
    u = t.orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("f"), F.max(F.to_date("o_orderdate")).alias("l"))
    return R.lifecycle(u, "f", "l", "2001-08-02").groupBy("tenure", "inactivity").agg(N().alias("n"))


@query("b11_maturity_filter", """
WITH u AS (SELECT user_id, min(CAST(ts AS DATE)) AS a FROM events GROUP BY 1)
SELECT CAST(a AS VARCHAR) AS anchor, count(*) AS users, count(CASE WHEN DATE '2024-01-31' - a >= 8 THEN 1 END) AS baked_7,
 count(CASE WHEN DATE '2024-01-31' - a >= 30 THEN 1 END) AS baked_30 FROM u GROUP BY 1""")
def b11(t):
    u = t.events.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("anchor"))
    return u.groupBy("anchor").agg(
        N().alias("users"), F.count_if(R.mature("anchor", "2024-01-31", 8)).alias("baked_7"),
        F.count_if(R.mature("anchor", "2024-01-31", 30)).alias("baked_30"))


# -- C joins ---------------------------------------------------------------

@query("c1_equi_join", """
SELECT r_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""", digits=2)
def c1(t):
    per = t.orders.groupBy("o_custkey").agg(N().alias("n"), F.sum("o_totalprice").alias("amount"))
    return (per.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
               .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
               .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
               .groupBy("r_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")))


@query("c2_offset_self_join", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), a AS (SELECT user_id, min(day) AS anchor FROM d GROUP BY 1)
SELECT day - anchor AS "offset", count(*) AS users FROM d JOIN a USING (user_id) WHERE day - anchor IN (0, 1, 3, 7, 14) GROUP BY 1""")
def c2(t):
    d = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    a = d.groupBy("user_id").agg(F.min("day").alias("anchor"))
    hits = R.offset_activity(d, a, "user_id", "day", "anchor", [0, 1, 3, 7, 14])
    return hits.groupBy("offset").agg(N().alias("users")).withColumn("offset", F.col("offset").cast("long"))


@query("c3_next_level_join", """
WITH s AS (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS first_date FROM orders GROUP BY 1, 2),
l AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, first_date FROM s)
SELECT a.level, count(*) AS users, count(b.level) AS reached, count(CASE WHEN date_diff('day', a.first_date, b.first_date) BETWEEN 0 AND 365 THEN 1 END) AS within_year
FROM l a LEFT JOIN l b ON a.o_custkey = b.o_custkey AND b.level = a.level + 1 GROUP BY 1""")
def c3(t):
    lv = (t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("first_date"))
           .select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), "first_date"))
    nxt = lv.select("o_custkey", (F.col("level") - 1).alias("level"), F.col("first_date").alias("next_date"))
    gap = F.date_diff("next_date", "first_date")
    return lv.join(nxt, ["o_custkey", "level"], "left").groupBy("level").agg(
        N().alias("users"), F.count("next_date").alias("reached"), F.count_if(gap.between(0, 365)).alias("within_year"))


@query("c4_interval_join", """
WITH s AS (SELECT user_id, min(ts) AS start, min(ts) + INTERVAL 5 DAY AS finish FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events e JOIN s USING (user_id)
WHERE e.ts BETWEEN s.start AND s.finish GROUP BY 1""", digits=2)
def c4(t):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("start")).withColumn("finish", F.col("start") + F.expr("INTERVAL 5 DAYS"))
    return R.interval_join(t.events, spans, ["user_id"], "ts", "start", "finish").groupBy("event_type").agg(
        N().alias("n"), F.sum("value").alias("total"))


@query("c5_calendar_range_join", """
WITH c AS (SELECT * FROM (VALUES ('launch', DATE '2024-01-03', DATE '2024-01-06'), ('sale', DATE '2024-01-05', DATE '2024-01-12'),
 ('season', DATE '2024-01-20', DATE '2024-01-29')) v(event, s, e))
SELECT event, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN c ON CAST(ts AS DATE) BETWEEN s AND e GROUP BY 1""")
def c5(t):
    per = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(N().alias("n"))
    hit = R.calendar_join(per, "day", event_calendar(t), "start", "end")
    return hit.groupBy("event").agg(F.sum("n").alias("n"), F.count_distinct("user_id").alias("users"))


def event_calendar(t):
    """Start-end rows of a small event calendar."""
    return t.spark.sql("""SELECT * FROM VALUES ('launch', DATE '2024-01-03', DATE '2024-01-06'),
        ('sale', DATE '2024-01-05', DATE '2024-01-12'), ('season', DATE '2024-01-20', DATE '2024-01-29') AS v(event, start, end)""")


@query("c6_trailing_lookup", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT count(*) AS purchases, count(CASE WHEN hit THEN 1 END) AS after_view FROM (
 SELECT p.event_id, bool_or(v.event_id IS NOT NULL) AS hit FROM p LEFT JOIN events v ON v.user_id = p.user_id
  AND v.event_type = 'view' AND v.ts BETWEEN p.ts - INTERVAL 3 HOUR AND p.ts GROUP BY 1)""")
def c6(t):
    from insightspark.operators.windows import trailing_hit
    marked = trailing_hit(t.events, ["user_id"], "ts", ["event_id"], F.col("event_type") == "view", hours=3)
    return marked.where("event_type = 'purchase'").agg(N().alias("purchases"), F.count_if("hit").alias("after_view"))


@query("c7_asof_lookup", """
SELECT e.event_id, max_by(v.value, v.ts) AS last_click_value, max(v.ts) IS NULL AS missing FROM events e
LEFT JOIN events v ON v.user_id = e.user_id AND v.event_type = 'click' AND v.ts < e.ts
WHERE e.event_type = 'purchase' GROUP BY 1""")
def c7(t):
    from insightspark.operators.windows import asof
    state = asof(t.events, ["user_id"], "ts", ["event_id"],
                 {"last_click_value": F.when(F.col("event_type") == "click", F.col("value"))})
    return state.where("event_type = 'purchase'").select(
        "event_id", "last_click_value", F.col("last_click_value").isNull().alias("missing"))


@query("c8_anti_join", """
SELECT o_orderstatus, count(*) AS orphan_orders FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""")
def c8(t):
    keys = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(keys, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(N().alias("orphan_orders"))


@query("c9_semi_join", """
SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND event_type = 'purchase') GROUP BY 1""")
def c9(t):
    buyers = t.events.where((F.to_date("ts") == "2024-01-15") & (F.col("event_type") == "purchase")).select("user_id")
    return t.events.join(buyers, "user_id", "left_semi").groupBy("event_type").agg(N().alias("n"))


@query("c10_param_cross_join", """
WITH p AS (SELECT avg(o_totalprice) AS base FROM orders)
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice) / max(base), 6) AS vs_base FROM orders, p GROUP BY 1""")
def c10(t):
    base = t.orders.agg(F.avg("o_totalprice")).scalar()
    per = t.orders.groupBy("o_orderpriority").agg(N().alias("n"), F.avg("o_totalprice").alias("a"))
    return per.select("o_orderpriority", "n", (F.col("a") / base).alias("vs_base"))


@query("c11_full_outer_reconcile", """
WITH l AS (SELECT o_custkey AS k, sum(o_totalprice) AS left_value FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1),
r AS (SELECT c_custkey AS k, sum(c_acctbal) AS right_value FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT CASE WHEN r.k IS NULL THEN 'only_left' WHEN l.k IS NULL THEN 'only_right'
 WHEN abs(left_value - right_value) <= 1e-6 * abs(right_value) THEN 'match' ELSE 'differs' END AS state, count(*) AS n
FROM l FULL OUTER JOIN r ON l.k = r.k GROUP BY 1""")
def c11(t):
    left = t.orders.where("o_orderdate < '1998-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("lv"))
    right = t.customer.where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("k")).agg(F.sum("c_acctbal").alias("rv"))
    return R.reconcile(left, right, ["k"], "lv", "rv").groupBy("state").agg(N().alias("n"))


@query("c12_double_attribute_join", """
SELECT c.n_regionkey AS user_region, s.n_regionkey AS partner_region, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation c ON c.n_nationkey = c_nationkey
LEFT JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2""")
def c12(t):
    pairs = (t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
              .groupBy("o_custkey", "l_suppkey").agg(N().alias("n"), F.sum("l_quantity").alias("qty"))
              .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
              .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left"))
    both = R.attributes_both_sides(pairs, "c_nationkey", "s_nationkey", t.nation, "n_nationkey", ["n_regionkey"])
    return both.groupBy(F.col("user_n_regionkey").alias("user_region"), F.col("partner_n_regionkey").alias("partner_region")).agg(
        F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query("c13_canonical_pair", """
SELECT concat_ws('|', least(CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)), greatest(CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR))) AS pair,
 count(*) AS n FROM lineitem GROUP BY 1""")
def c13(t):
    return t.lineitem.groupBy(R.pair_key("l_suppkey", "l_partkey").alias("pair")).agg(N().alias("n"))


@query("c14_join_cardinality", """
WITH a AS (SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS rows_after)
SELECT rows_before, rows_after, round(rows_after / rows_before, 6) AS growth, 'same' AS expected,
 CASE WHEN rows_after / rows_before > 2 THEN 'FAIL' WHEN rows_after = rows_before THEN 'PASS' ELSE 'WARN' END AS status FROM a""")
def c14(t):
    after = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.join_cardinality(t.orders, after)


# -- D aggregates ----------------------------------------------------------

@query("d1_grouped_agg", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS avg_discount,
 min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY 1, 2""")
def d1(t):
    return t.lineitem.where("l_shipdate <= '2000-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        N().alias("n"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("avg_discount"),
        F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("d2_count_distinct", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def d2(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("users"))


@query("d3_approx_distinct", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS approx_close, true AS sketch_close FROM lineitem GROUP BY 1""")
def d3(t):
    """Both sketches next to the exact count: within three times their standard error (0.02)."""
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.06 * F.col(b)
    g = t.lineitem.groupBy("l_returnflag")
    sketches = g.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("sketch"))
    exact = t.lineitem.select("l_returnflag", "l_orderkey").distinct().groupBy("l_returnflag").agg(N().alias("orders"))
    return sketches.join(exact, "l_returnflag").select("l_returnflag", "orders", near("approx", "orders").alias("approx_close"), near("sketch", "orders").alias("sketch_close"))


@query("d4_distinct_ratio", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT CASE WHEN event_type='purchase' THEN user_id END) AS n_hit,
 count(DISTINCT user_id) AS n_units, round(count(DISTINCT CASE WHEN event_type='purchase' THEN user_id END) / count(DISTINCT user_id), 6) AS rate
FROM events GROUP BY 1""")
def d4(t):
    return R.distinct_ratio(t.events.withColumn("day", F.to_date("ts")), ["day"], "user_id", F.col("event_type") == "purchase")


@query("d5_conditional_sums", """
SELECT l_suppkey, round(sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END), 2) AS sinks,
 round(sum(CASE WHEN l_returnflag<>'R' THEN l_quantity ELSE 0 END), 2) AS sources FROM lineitem GROUP BY 1""")
def d5(t):
    sink = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.when(sink, F.col("l_quantity")).otherwise(0)).alias("sinks"),
        F.sum(F.when(~sink, F.col("l_quantity")).otherwise(0)).alias("sources"))


@query("d6_first_finish_time", """
SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_time,
 strftime(min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate ELSE TIMESTAMP '2001-12-31 23:59:59' END), '%Y-%m-%d %H:%M:%S') AS finish_time
FROM orders GROUP BY 1""")
def d6(t):
    fallback = H.safe_timestamp(F.lit("12/31/2001 23:59:59"), "MM/dd/yyyy HH:mm:ss").cast("timestamp_ntz")
    return t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_time"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).otherwise(fallback)).alias("finish_time"))


@query("d7_multi_dimension_mix", """
WITH m AS (SELECT 'l_returnflag' AS dimension, l_returnflag AS bucket, count(*) AS n FROM lineitem GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
 UNION ALL SELECT 'size', CASE WHEN l_quantity <= 10 THEN 'a' WHEN l_quantity <= 30 THEN 'b' ELSE 'c' END, count(*) FROM lineitem GROUP BY 2
 UNION ALL SELECT 'year', CAST(year(l_shipdate) AS VARCHAR), count(*) FROM lineitem GROUP BY 2)
SELECT dimension, bucket, n, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM m""")
def d7(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", bucketize("l_quantity", [10, 30], ["a", "b", "c"]).alias("size"),
                           F.year("l_shipdate").alias("year"))
    return R.mix(df, ["l_returnflag", "l_linestatus", "size", "year"])


@query("d8_rollup", """
SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def d8a(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        F.grouping_id().alias("level"), N().alias("n"), F.sum("l_quantity").alias("qty"))


@query("d8_cube", """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def d8b(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), N().alias("n"))


@query("d8_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def d8c(t):
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(N().alias("n"))


@query("d9_percentile", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
 round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def d9(t):
    from insightspark.functions.ranks import quantiles_wide
    return quantiles_wide(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice",
                          {"p25": 0.25, "p50": 0.5, "p95": 0.95})


@query("d9_percentile_approx", "SELECT l_returnflag, count(*) AS n, true AS rank_close FROM lineitem GROUP BY 1")
def d9b(t):
    """The sketched median and its true rank, which is at most one part in 10,000 off the middle (and one row)."""
    p = t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 10000).alias("p50"))
    v = F.col("l_extendedprice")
    g = t.lineitem.join(p, "l_returnflag").groupBy("l_returnflag").agg(N().alias("n"), F.count_if(v < F.col("p50")).alias("below"), F.count_if(v <= F.col("p50")).alias("upto"))
    slack = F.col("n") / 10000 + 1
    return g.select("l_returnflag", "n", ((F.col("below") - slack <= F.col("n") / 2) & (F.col("upto") + slack >= F.col("n") / 2)).alias("rank_close"))


@query("d10_pivot", """
SELECT o_orderpriority, count(CASE WHEN o_orderstatus='F' THEN 1 END) AS "F", count(CASE WHEN o_orderstatus='O' THEN 1 END) AS "O",
 count(CASE WHEN o_orderstatus='P' THEN 1 END) AS "P" FROM orders GROUP BY 1""")
def d10(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(N()).fillna(0)


@query("d11_unpivot", """
SELECT measure, count(*) AS n, round(sum(v), 2) AS total FROM (
 SELECT unnest(['l_quantity', 'l_extendedprice']) AS measure, unnest([l_quantity, l_extendedprice]) AS v FROM lineitem) GROUP BY 1""", digits=2)
def d11(t):
    long = t.lineitem.unpivot(["l_orderkey"], ["l_quantity", "l_extendedprice"], "measure", "v")
    return long.groupBy("measure").agg(N().alias("n"), F.sum("v").alias("total"))


@query("d12_string_agg", """
SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def d12(t):
    t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).createOrReplaceTempView("_nation_region")
    return t.spark.sql("SELECT r_name, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM _nation_region GROUP BY r_name")


@query("d13_top_values", """
WITH l AS (SELECT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part
 UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
c AS (SELECT column_name, value, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c)
SELECT * FROM r WHERE rank <= 10""")
def d13(t):
    return R.top_values(t.part, ["p_brand", "p_type", "p_name", "p_size"]).withColumn("rank", F.col("rank").cast("long"))


@query("d14_ratio_of_sums", """
SELECT CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month,
 round(sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS return_rate FROM lineitem GROUP BY 1""")
def d14(t):
    num = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    return t.lineitem.groupBy(H.month_start("l_shipdate").alias("month")).agg(ratio(num, F.sum("l_quantity")).alias("return_rate"))


# -- F sort, limit, sample -------------------------------------------------

@query("f1_order_by", """
SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 1""")
def f1(t):
    return (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
             .groupBy("r_name").agg(N().alias("nations")).orderBy("r_name"))


@query("f2_top_k", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", digits=2)
def f2(t):
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("amount")).orderBy(F.desc("amount"), "o_custkey").limit(20)


@query("f3_top_k_per_group", """
WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT * FROM r WHERE rank <= 10""")
def f3(t):
    df = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    top = R.top_per_group(df, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)
    return top.withColumn("rank", F.col("rank").cast("long"))


def _taken(t, rows):
    """How many rows were taken, how many different ones, and how many the table knows with the same price."""
    known = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    return rows.join(known, "o_orderkey").agg(N().alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"), F.count_if(F.col("o_totalprice") == F.col("price")).alias("n_known"))


@query("f4_limit", "SELECT least(100, count(*)) AS n_rows, least(100, count(*)) AS n_keys, least(100, count(*)) AS n_known FROM orders")
def f4(t):
    return _taken(t, t.orders.limit(100))


@query("f5_sample", "SELECT true AS about_n, true AS all_known FROM orders LIMIT 1")
def f5(t):
    """A sample is about as large as asked for (five standard deviations) and holds rows of the table, each once."""
    got = _taken(t, R.sample_rows(t.orders, 1000))
    return got.select((F.abs(F.col("n_rows") - 1000) <= 160).alias("about_n"), ((F.col("n_keys") == F.col("n_rows")) & (F.col("n_known") == F.col("n_rows"))).alias("all_known"))


@query("f6_recent_events", """
WITH i AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS it, o_totalprice FROM orders),
d AS (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY it DESC) AS iteration_rank FROM i)
SELECT o_orderpriority, iteration_rank, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM d WHERE iteration_rank <= 3 GROUP BY 1, 2""", digits=2)
def f6(t):
    df = t.orders.withColumn("it", H.month_start("o_orderdate"))
    last = R.recent_iterations(df, ["o_orderpriority"], "it", 3)
    return last.groupBy("o_orderpriority", F.col("iteration_rank").cast("long").alias("iteration_rank")).agg(
        N().alias("n"), F.sum("o_totalprice").alias("amount"))


# -- G set operations ------------------------------------------------------

@query("g1_union_all", """
SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1""")
def g1(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(N().alias("n"))


@query("g2_except", """
SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01'""")
def g2(t):
    return t.customer.select(F.col("c_custkey").alias("custkey")).exceptAll(
        t.orders.where("o_orderdate < '1996-01-01'").select(F.col("o_custkey").alias("custkey")).distinct())


@query("g3_intersect", """
SELECT l_partkey % 1000 AS k FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='P'""")
def g3(t):
    return t.lineitem.where("l_returnflag = 'R'").select((F.col("l_partkey") % 1000).alias("k")).intersect(
        t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


# -- H scalar functions ----------------------------------------------------

@query("h1_safe_math", """
SELECT o_orderkey, round(o_totalprice / nullif(o_custkey % 7, 0), 4) AS per_slot, round(ln(o_totalprice), 6) AS ln_price,
 round(sqrt(abs(o_totalprice - 250000)), 6) AS dist FROM orders""")
def h1a(t):
    return t.orders.select("o_orderkey", F.round(H.safe_divide("o_totalprice", F.col("o_custkey") % 7), 4).alias("per_slot"),
                           F.ln("o_totalprice").alias("ln_price"), F.sqrt(F.abs(F.col("o_totalprice") - 250000)).alias("dist"))


@query("h1_dates", """
SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, date_diff('day', DATE '1995-01-01', o_orderdate) AS days,
 CAST((CAST(date_trunc('week', o_orderdate) AS DATE) - DATE '1994-12-26') / 7 AS BIGINT) AS weeks, date_diff('month', DATE '1995-01-01', o_orderdate) AS months,
 CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS plus30, dayname(o_orderdate) AS day_name, month(o_orderdate) AS month_no,
 weekofyear(o_orderdate) AS iso_week, quarter(o_orderdate) AS quarter_no FROM orders""")
def h1b(t):
    d = F.to_date("o_orderdate")
    base = F.lit("1995-01-01").cast("date")
    return t.orders.select(
        "o_orderkey", H.week_start("o_orderdate").alias("week"), H.days_between(d, base).cast("long").alias("days"),
        H.weeks_between(d, base).cast("long").alias("weeks"), H.months_between_calendar(d, base).cast("long").alias("months"),
        F.date_add(d, 30).alias("plus30"), F.date_format(d, "EEEE").alias("day_name"), F.month(d).cast("long").alias("month_no"),
        F.weekofyear(d).cast("long").alias("iso_week"), F.quarter(d).cast("long").alias("quarter_no"))


@query("h1_timestamps", """
SELECT event_id, strftime(ts - INTERVAL 3 MINUTE, '%Y-%m-%d %H:%M:%S') AS before, try_strptime(props, '%Y') IS NULL AS bad_text,
 strftime(try_strptime('2024-01-' || CAST(user_id % 40 AS VARCHAR), '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def h1c(t):
    return t.events.select(
        "event_id", (F.col("ts") - F.expr("INTERVAL 3 MINUTES")).alias("before"),
        H.safe_timestamp("props", "yyyy").isNull().alias("bad_text"),
        H.safe_timestamp(F.concat(F.lit("2024-01-"), (F.col("user_id") % 40).cast("string")), "yyyy-MM-d").alias("parsed"))


@query("h1_strings", """
SELECT c_custkey, lower(c_mktsegment) AS seg, c_name LIKE '%1' AS ends_one, concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR)) AS tag,
 least(c_acctbal, 1000.0) AS low, greatest(c_acctbal, 1000.0) AS high, length(c_name) AS len, trim('  ' || c_mktsegment || ' ') AS cut,
 length(trim(replace(c_mktsegment, 'BUILDING', ' '))) = 0 AS blank FROM customer""")
def h1d(t):
    seg = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.lower(seg).alias("seg"), F.col("c_name").like("%1").alias("ends_one"),
        F.concat(seg, F.lit("-"), F.col("c_nationkey").cast("string")).alias("tag"),
        F.least("c_acctbal", F.lit(1000.0)).alias("low"), F.greatest("c_acctbal", F.lit(1000.0)).alias("high"),
        F.length("c_name").cast("long").alias("len"), F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("cut"),
        H.blank(F.replace(seg, F.lit("BUILDING"), F.lit(" "))).alias("blank"))


@query("h1_conditionals", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
 CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open, coalesce(nullif(o_orderstatus, 'P'), 'none') AS st FROM orders""")
def h1e(t):
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.when(p > 300000, "high").when(p > 100000, "mid").otherwise("low").alias("band"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("is_open"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("st"))


@query("h1_json", """
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(json_extract_string(props, '$.missing')) AS missing FROM events GROUP BY 1""")
def h1f(t):
    return t.events.groupBy("event_type").agg(
        F.sum(H.json_field("props", "$.k").cast("long")).alias("k_sum"), F.count(H.json_field("props", "$.missing")).alias("missing"))


@query("h1_rounding", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 2, 0) AS half_even, round(l_quantity / 2) AS half_up FROM lineitem""")
def h1g(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             H.round_half_even(F.col("l_quantity") / 2, 0).alias("half_even"), F.round(F.col("l_quantity") / 2).alias("half_up"))


@query("u8_row_checksum", """
SELECT o_orderkey, md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
 coalesce(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END, ''), o_orderpriority)) AS checksum FROM orders""")
def u8(t):
    df = t.orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus")))
    return df.select("o_orderkey", H.row_md5(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("checksum"))
