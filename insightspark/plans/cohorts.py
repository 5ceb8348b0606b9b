"""Cohort, retention and reactivation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions.columns import bucketize
from insightspark.functions.scalars import week_start
from insightspark.operators import cohorts as C
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))
AS_OF = "2024-01-31"
#: Months that the orders span: one column each in the wide form.
MONTHS = 80
KINDS = ["signup", "view", "click", "purchase", "error"]


def days(t):
    """User-days with revenue and events."""
    return C.user_days(t.events, "user_id", "ts", {
        "revenue": F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0), "events": F.lit(1), "clicks": F.when(F.col("event_type") == "click", 1).otherwise(0)})


def sparse_days(t):
    """Days of each user and event type, over all events: the unit is fine enough for silent days."""
    kind = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("event_type"))
    return C.user_days(t.events.withColumn("user_id", F.col("user_id") * 10 + kind), "user_id", "ts", {"revenue": F.col("value")})


_UD = """ud AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS revenue, count(*) AS events, CAST(sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM events GROUP BY 1, 2),
an AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS anchor FROM ud), ao AS (SELECT *, day - anchor AS off, DATE '2024-01-31' - anchor AS age FROM an)"""

_OC = """fc AS (SELECT o_custkey, min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS cohort FROM orders GROUP BY 1), pm AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
h AS (SELECT cohort, date_diff('month', cohort, period) AS off, count(*) AS active, sum(v) AS v FROM pm JOIN fc USING (o_custkey) GROUP BY 1, 2), sz AS (SELECT cohort, active AS size FROM h WHERE off = 0),
lst AS (SELECT max(period) AS l FROM pm), span AS (SELECT date_diff('month', min(cohort), max(l)) AS top FROM sz, lst), gr AS (SELECT cohort, size, unnest(range(0, top + 1)) AS off FROM sz, span),
m AS (SELECT gr.cohort, gr.off, size, CASE WHEN gr.off <= date_diff('month', gr.cohort, l) THEN coalesce(active, 0) END AS active, coalesce(h.v, 0) AS v, gr.off <= date_diff('month', gr.cohort, l) AS reached FROM gr CROSS JOIN lst LEFT JOIN h ON h.cohort = gr.cohort AND h.off = gr.off)"""


@query("y3_cohort_assign", "WITH f AS (SELECT o_custkey, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS c FROM orders GROUP BY 1) SELECT CAST(c AS VARCHAR) AS cohort, count(*) AS cohort_size, count(*) < 50 AS small FROM f GROUP BY 1")
def y3(t):
    return C.cohort_assign(t.orders, "o_custkey", "o_orderdate")


@query("y4_retention_matrix", f"""WITH {_OC} SELECT CAST(cohort AS VARCHAR) AS cohort, CAST(off AS INT) AS "offset", size AS cohort_size, CAST(active AS DOUBLE) AS active, round(active/size, 6) AS retention FROM m""")
def y4(t):
    return C.retention_matrix(t.orders, "o_custkey", "o_orderdate").withColumn("active", F.col("active").cast("double"))


@query("y4_retention_wide", f"WITH {_OC} SELECT CAST(cohort AS VARCHAR) AS cohort, size AS cohort_size, " + ", ".join(f'round(max(CASE WHEN off = {i} THEN active/size END), 6) AS "{i}"' for i in range(MONTHS)) + " FROM m GROUP BY 1, 2")
def y4b(t):
    return C.retention_wide(C.retention_matrix(t.orders, "o_custkey", "o_orderdate"), MONTHS - 1)


@query("y5_aggregate_curve", f"""WITH {_OC}, r AS (SELECT off, active/size AS r FROM m WHERE size >= 20 AND active IS NOT NULL)
SELECT CAST(off AS INT) AS "offset", count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(stddev_samp(r)/sqrt(count(*)), 6) AS se FROM r GROUP BY 1""")
def y5(t):
    return C.aggregate_curve(C.retention_matrix(t.orders, "o_custkey", "o_orderdate"), 20, with_ci=False)


@query("y6_cohort_trend", f"""WITH {_OC}, r AS (SELECT off, cohort, active/size AS r, row_number() OVER (PARTITION BY off ORDER BY cohort) AS i FROM m WHERE off IN (1, 3, 6) AND active IS NOT NULL),
g AS (SELECT off, regr_slope(r, i) AS slope, avg(r) AS mean, stddev_samp(r) AS std, count(*) AS n FROM r GROUP BY 1)
SELECT CAST(g.off AS INT) AS "offset", round(slope, 6) AS slope, round(mean, 6) AS mean, round(std, 6) AS std, n AS n_cohorts, (SELECT count(*) FROM r WHERE r.off = g.off AND abs(r.r - g.mean) > 2*g.std) AS n_outliers FROM g""")
def y6(t):
    return C.cohort_trend(C.retention_matrix(t.orders, "o_custkey", "o_orderdate"), [1, 3, 6])


@query("y7_cohort_ltv", f"""WITH {_OC} SELECT CAST(cohort AS VARCHAR) AS cohort, CAST(off AS INT) AS "offset", size AS cohort_size, round(sum(v) OVER (PARTITION BY cohort ORDER BY off)/size, 6) AS ltv FROM m WHERE reached""")
def y7(t):
    return C.cohort_ltv(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("y7_ltv_maturity", f"""WITH {_OC}, l AS (SELECT cohort, off, sum(v) OVER (PARTITION BY cohort ORDER BY off)/size AS ltv FROM m WHERE reached), f AS (SELECT *, max(ltv) OVER (PARTITION BY cohort) AS final FROM l)
SELECT CAST(cohort AS VARCHAR) AS cohort, round(max(final), 6) AS final_ltv, CAST(min(CASE WHEN ltv >= 0.8*final THEN off END) AS INT) AS maturity_offset FROM f GROUP BY 1""")
def y7b(t):
    return C.ltv_maturity(C.cohort_ltv(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))


@query("y8_mature_benchmark", f"""WITH {_OC}, f AS (SELECT DISTINCT cohort FROM m ORDER BY cohort LIMIT 3), b AS (SELECT off, avg(active/size) AS bench FROM m WHERE cohort IN (SELECT cohort FROM f) GROUP BY 1)
SELECT CAST(cohort AS VARCHAR) AS cohort, CAST(m.off AS INT) AS "offset", round(active/size, 6) AS retention, round(bench, 6) AS benchmark, round(active/size - bench, 6) + 0.0 AS deviation, abs(active/size - bench) > 0.05 AS flag FROM m JOIN b USING (off) WHERE active IS NOT NULL""")
def y8(t):
    out = C.mature_benchmark(C.retention_matrix(t.orders, "o_custkey", "o_orderdate"))
    return out.select("cohort", "offset", "retention", "benchmark", "deviation", "flag")


@query("y9_dx_retention", f"WITH {_UD} " + " UNION ALL ".join(
    f"""SELECT {x} AS "offset", count(CASE WHEN off = 0 AND age > {x} THEN 1 END) AS mature_users, count(CASE WHEN off = {x} AND age > {x} THEN 1 END) AS retained, round(count(CASE WHEN off = {x} AND age > {x} THEN 1 END)/nullif(count(CASE WHEN off = 0 AND age > {x} THEN 1 END), 0), 6) AS retention FROM ao""" for x in (1, 3, 7, 14, 30)))
def y9(t):
    d = C.user_days(t.events, "user_id", "ts")
    return C.dx_retention(d, [1, 3, 7, 14, 30], AS_OF)


_DXV = "pu AS (SELECT user_id, user_id % 3 AS platform, max(age) AS age, " + ", ".join(f"sum(CASE WHEN off <= {x} THEN revenue END) AS v{x}" for x in (0, 7, 14)) + " FROM ao GROUP BY 1)"


@query("y10_dx_arpi_conversion", f"WITH {_UD}, {_DXV} " + " UNION ALL ".join(
    f"""SELECT platform, {x} AS "offset", count(CASE WHEN age > {x} THEN 1 END) AS mature_users, round(sum(CASE WHEN age > {x} THEN v{x} END)/count(CASE WHEN age > {x} THEN 1 END), 4) AS arpi, round(count(CASE WHEN age > {x} AND v{x} > 0 THEN 1 END)/count(CASE WHEN age > {x} THEN 1 END), 4) AS conversion FROM pu GROUP BY 1""" for x in (0, 7, 14)), digits=4)
def y10(t):
    d = days(t).withColumn("platform", F.col("user_id") % 3)
    return C.dx_value(d, [0, 7, 14], AS_OF, keys=["platform"])


@query("y11_anchored_metrics", f"WITH {_UD} SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS variant, " + ", ".join(
    f"count(CASE WHEN off = 0 AND age > {x} THEN 1 END) AS baked_{x}, round(sum(CASE WHEN age > {x} AND off <= {x} THEN revenue ELSE 0 END), 2) AS revenue_{x}, CAST(sum(CASE WHEN age > {x} AND off <= {x} THEN clicks ELSE 0 END) AS BIGINT) AS clicks_{x}" for x in (1, 7)) + " FROM ao GROUP BY 1", digits=2)
def y11(t):
    d = days(t).withColumn("variant", F.when(F.col("user_id") % 2 == 0, "control").otherwise("variant"))
    return C.anchored_metrics(d, [1, 7], ["revenue", "clicks"], AS_OF, ["variant"])


_RX = """sd AS (SELECT user_id*10 + list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) - 1 AS user_id, CAST(ts AS DATE) AS day, sum(value) AS revenue FROM events GROUP BY 1, 2),
rg AS (SELECT *, min(day) OVER (PARTITION BY user_id) AS anchor, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) - 1 AS gap FROM sd), rh AS (SELECT *, day - anchor AS tenure, coalesce(gap >= 2 AND day - anchor >= 5, false) AS hit FROM rg),
rx AS (SELECT *, CAST(coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM rh)"""


@query("y12_reactivation_detect", f"WITH {_RX} SELECT user_id, CAST(day AS VARCHAR) AS day, gap, tenure, prior AS prior_reactivations FROM rx WHERE hit")
def y12(t):
    r = C.reactivations(sparse_days(t), 2, 5)
    return r.select("user_id", "day", F.col("gap").cast("long").alias("gap"), F.col("tenure").cast("long").alias("tenure"), "prior_reactivations")


@query("y13_repeat_share", f"""WITH {_RX} SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, count(*) AS reactivations, count(CASE WHEN prior >= 2 THEN 1 END) AS repeats, round(count(CASE WHEN prior >= 2 THEN 1 END)/count(*), 6) AS share FROM rx WHERE hit GROUP BY 1""")
def y13(t):
    r = C.reactivations(sparse_days(t), 2, 5).withColumn("week", week_start("day"))
    return r.groupBy("week").agg(N().alias("reactivations"), F.count_if(F.col("prior_reactivations") >= 2).alias("repeats"), (F.count_if(F.col("prior_reactivations") >= 2) / N()).alias("share"))


@query("y14_weekly_scorecard", f"""WITH {_RX}, fw AS (SELECT x.*, (SELECT sum(revenue) FROM sd s WHERE s.user_id = x.user_id AND s.day BETWEEN x.day AND x.day + 7) AS rev, EXISTS (SELECT 1 FROM sd s WHERE s.user_id = x.user_id AND s.day = x.day + 7) AS ret FROM rx x WHERE hit AND DATE '2024-01-31' - day > 7),
o AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, user_id, user_id % 20 = 0 AS bad, max(ret) AS ret, sum(rev) AS rev, max(prior >= 2) AS rep, max(rev > 0) AS conv FROM fw GROUP BY 1, 2, 3),
g AS (SELECT week, count(CASE WHEN NOT bad THEN 1 END) AS u, count(CASE WHEN NOT bad AND ret THEN 1 END) AS a, count(CASE WHEN NOT bad AND conv THEN 1 END) AS b, sum(CASE WHEN NOT bad THEN rev END) AS c, count(CASE WHEN NOT bad AND rep THEN 1 END) AS d, count(CASE WHEN bad THEN 1 END) AS e, count(*) AS n FROM o GROUP BY 1)
SELECT CAST(week AS VARCHAR) AS week, u AS reactivated_users, round(a/u, 4) AS d7_retention, round(b/u, 4) AS d7_conversion, round(c/u, 4) AS d7_arpi, round(d/u, 4) AS repeat_share, round(e/n, 4) AS suspicious_share, round((u - lag(u) OVER (ORDER BY week))/lag(u) OVER (ORDER BY week), 4) AS users_wow FROM g""", digits=4)
def y14(t):
    flags = sparse_days(t).select("user_id").distinct().withColumn("suspicious", F.col("user_id") % 20 == 0)
    return C.weekly_scorecard(sparse_days(t), flags, AS_OF, 2, 5, repeat=2)


_GAPB = "CASE WHEN gap <= 3 THEN 'a. 2-3' WHEN gap <= 6 THEN 'b. 4-6' ELSE 'c. 7+' END"


@query("y15_mix_over_time", f"""WITH {_RX}, g AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, {_GAPB} AS dormancy, count(*) AS n FROM rx WHERE hit GROUP BY 1, 2)
SELECT CAST(week AS VARCHAR) AS week, dormancy, n, round(n/sum(n) OVER (PARTITION BY week), 6) AS share FROM g""")
def y15(t):
    r = C.reactivations(sparse_days(t), 2, 5).withColumn("week", week_start("day")).withColumn("dormancy", bucketize("gap", [3, 6], ["a. 2-3", "b. 4-6", "c. 7+"]))
    return C.mix_over_time(r, "week", "dormancy")


@query("y16_retention_by_bucket", f"""WITH {_RX}, fw AS (SELECT x.*, EXISTS (SELECT 1 FROM sd s WHERE s.user_id = x.user_id AND s.day = x.day + 7) AS ret FROM rx x WHERE hit AND DATE '2024-01-31' - day > 7),
g AS (SELECT user_id % 3 AS platform, {_GAPB} AS dormancy, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, count(CASE WHEN ret THEN 1 END) AS hit FROM fw GROUP BY 1, 2, 3),
p AS (SELECT *, avg(hit/n) OVER (PARTITION BY platform, dormancy ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pa FROM g)
SELECT platform, dormancy, CAST(week AS VARCHAR) AS week, n, hit, round(hit/n, 6) AS rate, round(pa, 6) AS prior_avg, round(hit/n - pa, 6) + 0.0 AS delta FROM p""")
def y16(t):
    r = C.reactivations(C.forward_window(sparse_days(t), "revenue"), 2, 5).where(F.date_diff(F.lit(AS_OF).cast("date"), F.col("day")) > 7)
    r = r.withColumn("platform", F.col("user_id") % 3).withColumn("dormancy", bucketize("gap", [3, 6], ["a. 2-3", "b. 4-6", "c. 7+"])).withColumn("week", week_start("day"))
    return C.retention_by_bucket(r, ["platform", "dormancy"], "week", "active_then")


@query("y17_cohort_table_retention", f"""WITH {_UD}, c AS (SELECT anchor, user_id % 3 AS platform, max(age) AS age, count(CASE WHEN off = 0 THEN 1 END) AS users, count(CASE WHEN off = 1 THEN 1 END) AS a1, count(CASE WHEN off = 7 THEN 1 END) AS a7 FROM ao GROUP BY 1, 2)
SELECT platform, round(sum(CASE WHEN age >= 1 THEN a1 END)/sum(CASE WHEN age >= 1 THEN users END), 6) AS d1_retention, round(sum(CASE WHEN age >= 7 THEN a7 END)/sum(CASE WHEN age >= 7 THEN users END), 6) AS d7_retention FROM c GROUP BY 1""")
def y17(t):
    a = C.with_anchor(days(t)).withColumn("off", F.date_diff("day", "anchor"))
    table = a.groupBy("anchor", (F.col("user_id") % 3).alias("platform")).agg(
        F.max(F.date_diff(F.lit(AS_OF).cast("date"), F.col("anchor"))).alias("age"), *[F.count_if(F.col("off") == x).alias(n) for x, n in ((0, "users"), (1, "a1"), (7, "a7"))])
    return C.cohort_table_retention(table, "age", "users", {1: "a1", 7: "a7"}, ["platform"])
