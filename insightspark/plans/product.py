"""Funnel, session, economy and engagement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions.scalars import month_start
from insightspark.operators import product as P
from insightspark.operators.cohorts import user_days
from insightspark.operators.relational import attributes_both_sides
from insightspark.plans.paradox import _OC, oc
from insightspark.plans.registry import query
from insightspark.plans.relational import event_calendar

N = lambda: F.count(F.lit(1))
STEPS = ["signup", "view", "click", "purchase"]


def _funnel_sql(by=""):
    k, kk = (f"{by}, ", "user_id % 3 AS platform, ") if by else ("", "")
    part = f"PARTITION BY {by}" if by else ""
    parts = []
    for i, s in enumerate(STEPS, start=1):
        mins = "NULL" if i == 1 else f"date_diff('microsecond', t{i-1}, t{i})/6e7"
        parts.append(f"SELECT {kk}{i} AS step_no, '{s}' AS step, t{i} IS NOT NULL AS hit, CAST({mins} AS DOUBLE) AS minutes FROM f4")
    return f"""WITH f1 AS (SELECT user_id, min(ts) AS t1 FROM events WHERE event_type='signup' GROUP BY 1),
f2 AS (SELECT f1.*, (SELECT min(ts) FROM events e WHERE e.user_id = f1.user_id AND event_type='view' AND ts >= t1 AND ts <= t1 + INTERVAL 48 HOUR) AS t2 FROM f1),
f3 AS (SELECT f2.*, (SELECT min(ts) FROM events e WHERE e.user_id = f2.user_id AND event_type='click' AND ts >= t2 AND ts <= t2 + INTERVAL 48 HOUR) AS t3 FROM f2),
f4 AS (SELECT f3.*, (SELECT min(ts) FROM events e WHERE e.user_id = f3.user_id AND event_type='purchase' AND ts >= t3 AND ts <= t3 + INTERVAL 48 HOUR) AS t4 FROM f3),
l AS ({' UNION ALL '.join(parts)}), g AS (SELECT {k}step_no, step, count(CASE WHEN hit THEN 1 END) AS users, median(minutes) AS med FROM l GROUP BY {k}step_no, step),
r AS (SELECT *, lag(users) OVER ({part} ORDER BY step_no) AS prev, first_value(users) OVER ({part} ORDER BY step_no) AS first FROM g)
SELECT {k}CAST(step_no AS INT) AS step_no, step, users, round(users/prev, 4) AS step_rate, round(users/first, 4) AS total_rate, CAST(prev - users AS DOUBLE) AS lost, coalesce(prev - users = max(prev - users) OVER ({part}), false) AS biggest_loss,
 coalesce(users/prev = min(users/prev) OVER ({part}), false) AS worst_rate, round(med, 4) AS median_minutes FROM r"""


@query("y19_funnel", _funnel_sql(), digits=4)
def y19(t):
    return P.funnel(P.funnel_times(t.events, "user_id", "ts", "event_type", STEPS, 48), STEPS).withColumn("lost", F.col("lost").cast("double"))


@query("y19_funnel_by_segment", _funnel_sql("platform"), digits=4)
def y19b(t):
    times = P.funnel_times(t.events, "user_id", "ts", "event_type", STEPS, 48).withColumn("platform", F.col("user_id") % 3)
    return P.funnel(times, STEPS, ["platform"]).withColumn("lost", F.col("lost").cast("double"))


@query("y20_step_rate", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id, max(event_type='view') AS a, max(event_type='purchase') AS b FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, count(CASE WHEN a THEN 1 END) AS users_a, count(CASE WHEN a AND b THEN 1 END) AS users_b, round(count(CASE WHEN a AND b THEN 1 END)/count(CASE WHEN a THEN 1 END), 6) AS rate FROM d GROUP BY 1""")
def y20(t):
    return P.same_day_step_rate(t.events, "user_id", "ts", "event_type", "view", "purchase")


@query("y18_progression", """
WITH l AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS level FROM events WHERE event_type='purchase'),
n AS (SELECT a.user_id % 2 AS variant, a.level, date_diff('microsecond', a.ts, b.ts)/8.64e10 AS gap FROM l a LEFT JOIN l b ON b.user_id = a.user_id AND b.level = a.level + 1)
SELECT variant, level, count(*) AS users_started, count(CASE WHEN gap <= 1 THEN 1 END) AS progressed_d1, count(CASE WHEN gap <= 3 THEN 1 END) AS progressed_d3, count(CASE WHEN gap <= 7 THEN 1 END) AS progressed_d7,
 round(count(CASE WHEN gap <= 1 THEN 1 END)/count(*), 6) AS d1_progression, round(count(CASE WHEN gap <= 3 THEN 1 END)/count(*), 6) AS d3_progression, round(count(CASE WHEN gap <= 7 THEN 1 END)/count(*), 6) AS d7_progression FROM n GROUP BY 1, 2""")
def y18(t):
    lv = P.levels(t.events.where("event_type = 'purchase'"), "user_id", "ts", "event_id").withColumn("variant", F.col("user_id") % 2)
    return P.progression(lv, "user_id", ["variant"], [1, 3, 7])


@query("y21_segment_profile", f"""WITH {_OC}, l AS (SELECT 'c_mktsegment' AS dimension, c_mktsegment AS segment, o_totalprice AS v FROM oc UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM oc UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), o_totalprice FROM oc),
g AS (SELECT dimension, segment, count(*) AS n, avg(v) AS mean FROM l GROUP BY 1, 2), o AS (SELECT avg(o_totalprice) AS overall FROM oc)
SELECT dimension, segment, n, round(n/sum(n) OVER (PARTITION BY dimension), 4) AS share, round(mean, 4) AS mean, round(overall, 4) AS overall, round(100*(mean-overall)/abs(overall), 4) AS vs_average_pct, abs(100*(mean-overall)/abs(overall)) > 20 AS flag, n < 100 AS small FROM g, o""", digits=4)
def y21(t):
    return P.segment_profile(oc(t), ["c_mktsegment", "o_orderpriority", "c_nationkey"], "o_totalprice")


def user_features(t):
    on = lambda k, v: F.sum(F.when(F.col("event_type") == k, v).otherwise(0.0))
    return t.events.groupBy("user_id").agg(on("purchase", F.col("value")).alias("revenue"), on("view", F.lit(1.0)).alias("views"), on("click", F.lit(1.0)).alias("clicks"),
                                           on("error", F.lit(1.0)).alias("errors"), on("signup", F.lit(1.0)).alias("signups"), N().cast("double").alias("events"))


_UF = """u AS (SELECT user_id, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS revenue, CAST(count(CASE WHEN event_type='view' THEN 1 END) AS DOUBLE) AS views, CAST(count(CASE WHEN event_type='click' THEN 1 END) AS DOUBLE) AS clicks,
 CAST(count(CASE WHEN event_type='error' THEN 1 END) AS DOUBLE) AS errors, CAST(count(*) AS DOUBLE) AS events FROM events GROUP BY 1)"""
_DRIVERS = ["views", "clicks", "errors", "events"]


@query("y22_drivers", f"WITH {_UF}, c AS (" + " UNION ALL ".join(f"SELECT '{d}' AS driver, corr({d}, revenue) AS r FROM u" for d in _DRIVERS) + ") SELECT driver, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, driver) AS rank FROM c")
def y22(t):
    return P.driver_correlations(user_features(t), "revenue", _DRIVERS).withColumn("rank", F.col("rank").cast("long"))


@query("y22_top_bottom", f"WITH {_UF}, q AS (SELECT quantile_cont(revenue, 0.25) AS lo, quantile_cont(revenue, 0.75) AS hi FROM u) " + " UNION ALL ".join(
    f"SELECT '{d}' AS driver, round(avg(CASE WHEN revenue >= hi THEN {d} END), 4) AS top_mean, round(avg(CASE WHEN revenue <= lo THEN {d} END), 4) AS bottom_mean, round(avg(CASE WHEN revenue >= hi THEN {d} END) - avg(CASE WHEN revenue <= lo THEN {d} END), 4) AS difference FROM u, q" for d in _DRIVERS), digits=4)
def y22b(t):
    return P.top_bottom_difference(user_features(t), "revenue", _DRIVERS)


@query("y22_driver_importance")
def y22c(t):
    return P.driver_importance(user_features(t), "revenue", [*_DRIVERS, "signups"])


def ledger(t):
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return t.lineitem.select("l_suppkey", "l_orderkey", F.to_date("l_shipdate").alias("day"), month_start("l_shipdate").alias("month"), q.alias("quantity"), "l_linestatus")


_LG = "lg AS (SELECT l_suppkey, l_orderkey, l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem)"


@query("y31_economy_ratio", f"WITH {_LG} SELECT l_suppkey, round(sum(CASE WHEN q > 0 THEN q ELSE 0 END), 2) AS sources, round(sum(CASE WHEN q < 0 THEN -q ELSE 0 END), 2) AS sinks, round(sum(CASE WHEN q > 0 THEN q ELSE 0 END)/nullif(sum(CASE WHEN q < 0 THEN -q ELSE 0 END), 0), 6) AS ratio FROM lg GROUP BY 1")
def y31(t):
    return P.economy_ratio(ledger(t), ["l_suppkey"], "quantity")


@query("y31_economy_curve", f"""WITH {_LG}, g AS (SELECT l_linestatus, month, sum(CASE WHEN q > 0 THEN q ELSE 0 END) AS s, sum(CASE WHEN q < 0 THEN -q ELSE 0 END) AS k FROM lg GROUP BY 1, 2)
SELECT l_linestatus, CAST(month AS VARCHAR) AS month, sum(s) OVER w AS sources, sum(k) OVER w AS sinks, round(sum(s) OVER w / nullif(sum(k) OVER w, 0), 6) AS ratio FROM g WINDOW w AS (PARTITION BY l_linestatus ORDER BY month)""")
def y31b(t):
    return P.economy_curve(ledger(t), ["l_linestatus"], "month", "quantity")


@query("y32_milestone_economy", """
WITH s AS (SELECT o_custkey, o_orderpriority, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1, 2),
f AS (SELECT o_custkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS p, CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS n_facts, round(sum(p), 2) AS revenue, round(sum(CASE WHEN q > 0 THEN q END), 2) AS source, round(sum(CASE WHEN q < 0 THEN -q END), 2) AS spent FROM f JOIN s USING (o_custkey) WHERE day BETWEEN a AND b GROUP BY 1""", digits=2)
def y32(t):
    spans = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    facts = (t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
              .select("o_custkey", F.to_date("l_shipdate").alias("day"), "l_extendedprice", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q")))
    return P.milestone_economy(spans, facts, "o_custkey", "day", "a", "b", ["o_orderpriority"], {
        "revenue": F.col("l_extendedprice"), "source": F.when(F.col("q") > 0, F.col("q")), "spent": F.when(F.col("q") < 0, -F.col("q"))})


def platform_days(t):
    per = t.events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(N().alias("n"))
    return per.groupBy("day", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("platform")).agg(N().alias("actives"))


_PD = """pd AS (SELECT CAST(ts AS DATE) AS day, 'p' || CAST(user_id % 3 AS VARCHAR) AS platform, count(DISTINCT user_id) AS actives FROM events GROUP BY 1, 2),
cal AS (SELECT * FROM (VALUES ('launch', DATE '2024-01-03', DATE '2024-01-06'), ('sale', DATE '2024-01-05', DATE '2024-01-12'), ('season', DATE '2024-01-20', DATE '2024-01-29')) v(event, s, e)),
ew AS (SELECT event, platform, day - s AS off, sum(actives) AS value FROM pd JOIN cal ON day BETWEEN s - 30 AND s + 30 GROUP BY 1, 2, 3)"""


@query("y33_event_window_activity", f'WITH {_PD} SELECT event, platform, CAST(off AS INT) AS "offset", CAST(value AS BIGINT) AS value FROM ew')
def y33(t):
    return P.event_window_activity(platform_days(t), event_calendar(t), "day", "platform", "actives")


@query("y33_gap_widening", f"""WITH {_PD}, g AS (SELECT event, off, sum(CASE WHEN platform='p0' THEN value END) - sum(CASE WHEN platform='p1' THEN value END) AS gap FROM ew GROUP BY 1, 2),
r AS (SELECT event, avg(CASE WHEN off < 0 THEN gap END) AS a, avg(CASE WHEN off >= 0 THEN gap END) AS b FROM g GROUP BY 1) SELECT event, round(a, 6) AS gap_pre, round(b, 6) AS gap_post, round(b - a, 6) AS widening FROM r""")
def y33b(t):
    w = P.event_window_activity(platform_days(t), event_calendar(t), "day", "platform", "actives")
    return P.gap_widening(w, "platform", "p0", "p1")


@query("y34_lapse_rate", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
w AS (SELECT user_id, day, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS b, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAYS FOLLOWING) AS a FROM d)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS users, count(CASE WHEN a < b THEN 1 END) AS lapsing, round(count(CASE WHEN a < b THEN 1 END)/count(*), 6) AS lapse_rate FROM w WHERE DATE '2024-01-31' - day > 7 GROUP BY 1""")
def y34(t):
    return P.lapse_rate(user_days(t.events, "user_id", "ts"), "2024-01-31")


@query("y35_continuous_engagement", f"""WITH {_PD}, g AS (SELECT event, user_id, s, e, max(CAST(ts AS DATE)) AS l FROM events JOIN cal ON CAST(ts AS DATE) BETWEEN s AND e WHERE event_type='purchase' GROUP BY 1, 2, 3, 4)
SELECT event, user_id, round((l - s)/(e - s), 6) AS position FROM g""")
def y35(t):
    return P.engagement_span(t.events.where("event_type = 'purchase'"), "user_id", "ts", event_calendar(t)).select("event", "user_id", "position")


@query("y36_pairing_matrix", """
SELECT c.n_regionkey AS user_region, round(avg(CASE WHEN s.n_regionkey=0 THEN l_quantity END), 4) AS "0", round(avg(CASE WHEN s.n_regionkey=1 THEN l_quantity END), 4) AS "1", round(avg(CASE WHEN s.n_regionkey=2 THEN l_quantity END), 4) AS "2",
 round(avg(CASE WHEN s.n_regionkey=3 THEN l_quantity END), 4) AS "3", round(avg(CASE WHEN s.n_regionkey=4 THEN l_quantity END), 4) AS "4" FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1""", digits=4)
def y36(t):
    pairs = (t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("s"), N().alias("n"))
              .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    both = attributes_both_sides(pairs, "c_nationkey", "s_nationkey", t.nation, "n_nationkey", ["n_regionkey"])
    return both.groupBy(F.col("user_n_regionkey").alias("user_region")).pivot("partner_n_regionkey", [0, 1, 2, 3, 4]).agg(F.sum("s") / F.sum("n"))


@query("y37_iteration_compare", f"""WITH {_OC}, i AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS it, c_mktsegment, sum(o_totalprice) AS n, CAST(count(*) AS DOUBLE) AS d FROM oc GROUP BY 1, 2), b AS (SELECT c_mktsegment, sum(d) AS b FROM i GROUP BY 1),
g AS (SELECT it, sum(n)/sum(d) AS rate, sum(n/d*b)/sum(b) AS nr FROM i JOIN b USING (c_mktsegment) GROUP BY 1), p AS (SELECT *, avg(rate) OVER (ORDER BY it ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pm FROM g)
SELECT CAST(it AS VARCHAR) AS it, round(rate, 4) AS rate, round(nr, 4) AS normalised_rate, round(pm, 4) AS prior_mean, round(100*(rate-pm)/abs(pm), 4) AS change_pct FROM p""", digits=4)
def y37(t):
    df = oc(t).select(F.trunc("o_orderdate", "quarter").alias("it"), "c_mktsegment", "o_totalprice", F.lit(1.0).alias("one"))
    return P.iteration_compare(df, "it", "c_mktsegment", "o_totalprice", "one")


@query("y38_active_network_rate", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20'), n AS (SELECT user_id, count(DISTINCT CAST(json_extract_string(props, '$.k') AS INT)) AS k FROM events GROUP BY 1)
SELECT count(*) AS active_users, count(CASE WHEN k >= 40 THEN 1 END) AS connected, round(count(CASE WHEN k >= 40 THEN 1 END)/count(*), 6) AS rate FROM a LEFT JOIN n USING (user_id)""")
def y38(t):
    a = t.events.where(F.to_date("ts") == "2024-01-20").select("user_id").distinct()
    n = t.events.groupBy("user_id").agg(F.count_distinct(F.get_json_object("props", "$.k")).alias("n_links"))
    return P.active_network_rate(a, n, "user_id", 40)


@query("y39_time_to_first_win", """
WITH u AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, min(CASE WHEN o_orderstatus='F' THEN CAST(o_orderdate AS DATE) END) AS w FROM orders GROUP BY 1), h AS (SELECT unnest([30, 90, 365]) AS h)
SELECT CAST(h AS INT) AS horizon, count(CASE WHEN DATE '2001-08-01' - f >= h THEN 1 END) AS mature_users, count(CASE WHEN DATE '2001-08-01' - f >= h AND w - f <= h THEN 1 END) AS winners,
 round(count(CASE WHEN DATE '2001-08-01' - f >= h AND w - f <= h THEN 1 END)/count(CASE WHEN DATE '2001-08-01' - f >= h THEN 1 END), 6) AS share FROM u, h GROUP BY 1""")
def y39(t):
    return P.time_to_first(t.orders, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "F", [30, 90, 365], "2001-08-01")


_SS = """p AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events), n AS (SELECT *, sum(CASE WHEN pt IS NULL OR ts > pt + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM p),
s AS (SELECT user_id, CAST(sn AS BIGINT) AS session_no, min(ts) AS a, max(ts) AS b, count(*) AS n_events FROM n GROUP BY 1, 2)"""


@query("y40_sessionize", f"WITH {_SS} SELECT user_id, session_no, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, n_events, round(date_diff('microsecond', a, b)/1e6, 3) AS seconds FROM s", digits=3)
def y40(t):
    return P.sessionize(t.events, "user_id", "ts", "event_id")


@query("y40_sessions_filter", f"WITH {_SS} SELECT count(*) AS sessions, count(DISTINCT user_id) AS users, round(avg(date_diff('microsecond', a, b)/1e6), 3) AS mean_seconds FROM s WHERE date_diff('microsecond', a, b)/1e6 >= 60", digits=3)
def y40b(t):
    s = P.sessionize(t.events, "user_id", "ts", "event_id").where("seconds >= 60")
    return s.agg(N().alias("sessions"), F.count_distinct("user_id").alias("users"), F.avg("seconds").alias("mean_seconds"))
