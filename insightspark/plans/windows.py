"""Window function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions import scalars as H
from insightspark.functions.columns import ratio
from insightspark.functions.ranks import quantiles_wide
from insightspark.operators import windows as Wn
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))


def daily(t):
    """One row per day: events, active users, revenue."""
    per = t.events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(
        N().alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("rev"))
    return per.groupBy("day").agg(F.sum("n").alias("events"), N().alias("users"), F.sum("rev").alias("revenue"))


DAILY_SQL = """d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS events, count(DISTINCT user_id) AS users,
 sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS revenue FROM events GROUP BY 1)"""

MONTHLY_SQL = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS prio, count(*) AS n,
 round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1, 2)"""


def monthly(t):
    return t.orders.groupBy(H.month_start("o_orderdate").alias("month"), F.col("o_orderpriority").alias("prio")).agg(
        N().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("e1_running_count", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq FROM events""")
def e1(t):
    return Wn.running(t.events, ["user_id"], "ts", ["event_id"], {"seq": F.lit(1)}).select("event_id", F.col("seq").cast("long").alias("seq"))


@query("e2_prior_count", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events""")
def e2(t):
    return Wn.running(t.events, ["user_id"], "ts", ["event_id"], {"prior": F.lit(1)}, inclusive=False).select(
        "event_id", F.col("prior").cast("long").alias("prior"))


@query("e3_running_sums", """
WITH s AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(CASE WHEN l_returnflag<>'R' THEN l_quantity ELSE 0 END) AS src,
 sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) AS snk FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(day AS VARCHAR) AS day, sum(src) OVER w AS sources, sum(snk) OVER w AS sinks,
 round(sum(src) OVER w / nullif(sum(snk) OVER w, 0), 6) AS ratio FROM s
WINDOW w AS (PARTITION BY l_suppkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def e3(t):
    sink = F.col("l_returnflag") == "R"
    s = t.lineitem.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.sum(F.when(~sink, F.col("l_quantity")).otherwise(0)).alias("src"),
        F.sum(F.when(sink, F.col("l_quantity")).otherwise(0)).alias("snk"))
    out = Wn.cumulative(s, ["l_suppkey"], "day", "src").withColumnRenamed("cumulative", "sources")
    out = Wn.cumulative(out, ["l_suppkey"], "day", "snk").withColumnRenamed("cumulative", "sinks")
    return out.select("l_suppkey", "day", "sources", "sinks", ratio("sources", "sinks").alias("ratio"))


@query("e4_share_of_total", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2""")
def e4(t):
    return Wn.share_of_total(t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(N().alias("n")), ["o_orderstatus"], "n")


@query("e5_partition_percentile", """
WITH m AS (SELECT c_nationkey, median(c_acctbal) AS med FROM customer GROUP BY 1)
SELECT c_custkey, round(c_acctbal - med, 4) AS vs_median FROM customer JOIN m USING (c_nationkey)""", digits=4)
def e5(t):
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    med = quantiles_wide(c, ["c_nationkey"], "c_acctbal", {"med": 0.5})
    return c.join(med, "c_nationkey").select("c_custkey", (F.col("c_acctbal") - F.col("med")).alias("vs_median"))


@query("e6_rolling_stats", f"""
WITH {DAILY_SQL}
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN count(events) OVER w >= 3 THEN round(avg(events) OVER w, 6) END AS roll_mean,
 CASE WHEN count(events) OVER w >= 3 THEN round(stddev_samp(events) OVER w, 6) END AS roll_std FROM d
WINDOW w AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def e6(t):
    return Wn.rolling(daily(t), [], "day", "events", 14, 3).select("day", "roll_mean", "roll_std")


@query("e7_lagged_rolling_stats", f"""
WITH {DAILY_SQL}
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN count(events) OVER w >= 3 THEN round(avg(events) OVER w, 6) END AS roll_mean,
 CASE WHEN count(events) OVER w >= 3 THEN round(stddev_samp(events) OVER w, 6) END AS roll_std FROM d
WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def e7(t):
    return Wn.rolling(daily(t), [], "day", "events", 3, 3, lagged=True).select("day", "roll_mean", "roll_std")


@query("e8_period_change", f"""
WITH {MONTHLY_SQL}
SELECT CAST(month AS VARCHAR) AS month, prio, n, CAST(n - lag(n) OVER w AS DOUBLE) AS mom, round(100.0*(n - lag(n) OVER w)/nullif(lag(n) OVER w, 0), 6) AS mom_pct,
 CAST(n - lag(n, 3) OVER w AS DOUBLE) AS qoq, CAST(n - lag(n, 12) OVER w AS DOUBLE) AS yoy FROM m WINDOW w AS (PARTITION BY prio ORDER BY month)""")
def e8(t):
    m = Wn.period_change(monthly(t), ["prio"], "month", "n")
    m = m.select("month", "prio", "n", F.col("change").cast("double").alias("mom"), F.col("change_pct").alias("mom_pct"))
    m = Wn.period_change(m, ["prio"], "month", "n", 3).withColumn("qoq", F.col("change").cast("double")).drop("previous", "change", "change_pct")
    return Wn.period_change(m, ["prio"], "month", "n", 12).withColumn("yoy", F.col("change").cast("double")).drop("previous", "change", "change_pct")


@query("e9_rolling_average", f"""
WITH {MONTHLY_SQL}
SELECT CAST(month AS VARCHAR) AS month, prio, round(avg(n) OVER (PARTITION BY prio ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_avg FROM m""")
def e9(t):
    return Wn.rolling_average(monthly(t), ["prio"], "month", "n", "month").select("month", "prio", "rolling_avg")


@query("e10_cumulative", f"""
WITH {MONTHLY_SQL}
SELECT CAST(month AS VARCHAR) AS month, prio, CAST(sum(n) OVER (PARTITION BY prio, year(month) ORDER BY month) AS BIGINT) AS ytd FROM m""")
def e10(t):
    m = monthly(t).withColumn("year", F.year("month"))
    return Wn.cumulative(m, ["prio", "year"], "month", "n").select("month", "prio", F.col("cumulative").alias("ytd"))


@query("e11_quintile_score", """
WITH e AS (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS q FROM customer)
SELECT c_custkey, 1 + CAST(c_acctbal > q[1] AS BIGINT) + CAST(c_acctbal > q[2] AS BIGINT) + CAST(c_acctbal > q[3] AS BIGINT) + CAST(c_acctbal > q[4] AS BIGINT) AS score FROM customer, e""")
def e11(t):
    return Wn.quintile_score(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "score").select(
        "c_custkey", F.col("score").cast("long").alias("score"))


@query("e12_rank", """
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer""")
def e12(t):
    return Wn.global_rank(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "rank")


@query("e13_average_rank", """
WITH r AS (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_quantity) AS n FROM lineitem)
SELECT l_quantity, max(n) AS n, round(max(r + (n - 1) / 2.0), 6) AS avg_rank FROM r GROUP BY 1""")
def e13(t):
    return Wn.average_ranks(t.lineitem, [], "l_quantity")


@query("e14_islands", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
b AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
s AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
m AS (SELECT s.* FROM s ANTI JOIN d USING (user_id, day)),
g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS k FROM m)
SELECT user_id, CAST(min(day) AS VARCHAR) AS gap_start, CAST(max(day) AS VARCHAR) AS gap_end, count(*) AS length FROM g GROUP BY user_id, k""")
def e14(t):
    days = t.events.select("user_id", F.to_date("ts").alias("day"))
    return Wn.islands(Wn.missing_days(days, ["user_id"], "day"), ["user_id"], "day")


@query("e15_first_event", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type, value FROM r WHERE rn = 1""")
def e15(t):
    return Wn.first_event(t.events, ["user_id"], "ts", "event_id", ["event_type", "value"])
