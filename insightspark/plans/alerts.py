"""Alert queries and the catalogue of alert metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio
from insightspark.operators import alerts as A
from insightspark.operators.cohorts import forward_window, user_days, with_anchor
from insightspark.plans.registry import query
from insightspark.plans.relational import event_calendar
from insightspark.plans.windows import DAILY_SQL, daily

N = lambda: F.count(F.lit(1))
Alert = A.Alert


def user_day_table(t):
    """Wide user-day rows: the table every catalogue metric reads."""
    is_ = lambda k: F.when(F.col("event_type") == k, 1).otherwise(0)
    d = user_days(t.events, "user_id", "ts", {
        "events": F.lit(1), "revenue": F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0), "purchases": is_("purchase"), "views": is_("view"), "clicks": is_("click"),
        "errors": is_("error"), "signups": is_("signup")})
    w = W.partitionBy("user_id").orderBy("day")
    d = with_anchor(forward_window(d, "revenue", 7)).withColumnRenamed("value_ahead", "revenue_d7").withColumnRenamed("active_then", "active_d7")
    nxt = F.lead("day").over(w)
    d = d.withColumn("active_d1", F.coalesce(F.date_diff(nxt, "day") == 1, F.lit(False))).withColumn("gap", F.coalesce(F.date_diff(F.col("day"), F.lag("day").over(w)) - 1, F.lit(0)))
    return (d.withColumn("is_new", F.col("day") == F.col("anchor")).withColumn("platform", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))
             .withColumn("suspicious", F.col("user_id") % 20 == 0).withColumn("paid_source", F.col("user_id") % 4 == 1).withColumn("guest", F.col("user_id") % 7 == 0)
             .withColumn("came_back", F.col("gap") >= 1))


_UDT = """b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS events, sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS revenue, count(CASE WHEN event_type='purchase' THEN 1 END) AS purchases, count(CASE WHEN event_type='view' THEN 1 END) AS views,
 count(CASE WHEN event_type='click' THEN 1 END) AS clicks, count(CASE WHEN event_type='error' THEN 1 END) AS errors, count(CASE WHEN event_type='signup' THEN 1 END) AS signups FROM events GROUP BY 1, 2),
t AS (SELECT *, sum(revenue) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 7 DAYS FOLLOWING) AS revenue_d7, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS FOLLOWING AND INTERVAL 7 DAYS FOLLOWING) > 0 AS active_d7,
 min(day) OVER (PARTITION BY user_id) AS anchor, coalesce(lead(day) OVER (PARTITION BY user_id ORDER BY day) - day = 1, false) AS active_d1, coalesce(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) - 1, 0) AS gap FROM b),
x AS (SELECT *, day = anchor AS is_new, 'p' || CAST(user_id % 3 AS VARCHAR) AS platform, user_id % 20 = 0 AS suspicious, user_id % 4 = 1 AS paid_source, user_id % 7 = 0 AS guest, gap >= 1 AS came_back FROM t)"""

# One row per alert: name, Spark metric, filter. The metrics cover the volume,
# share, retention, spend, conversion and engagement alerts of the catalogue.
NEW_USER_METRICS = {
    "new_users": "count(user_id)", "new_paid_share": "try_divide(count_if(paid_source), count(user_id))", "new_suspicious_share": "try_divide(count_if(suspicious), count(user_id))",
    "new_start_rate": "try_divide(count_if(clicks > 0), count(user_id))", "new_d1_retention": "try_divide(count_if(active_d1), count(user_id))", "new_d7_retention": "try_divide(count_if(active_d7), count(user_id))",
    "new_avg_spend": "avg(revenue)", "new_popup_rate": "try_divide(count_if(views > 0), count(user_id))", "new_d0_conversion": "try_divide(count_if(purchases > 0), count(user_id))",
    "new_d7_arpi": "try_divide(sum(revenue_d7), count(user_id))", "new_guest_share": "try_divide(count_if(guest), count(user_id))", "new_participation": "try_divide(count_if(clicks >= 2), count(user_id))",
}
RETURNING_METRICS = {
    "ret_users": "count(user_id)", "ret_d1_retention": "try_divide(count_if(active_d1), count(user_id))", "ret_d7_retention": "try_divide(count_if(active_d7), count(user_id))",
    "ret_events_per_user": "try_divide(sum(events), count(user_id))", "ret_spend": "avg(revenue)", "ret_d7_conversion": "try_divide(count_if(revenue_d7 > 0), count(user_id))",
    "ret_payer_arpdau": "try_divide(sum(revenue), count_if(purchases > 0))", "ret_long_gap_share": "try_divide(count_if(gap >= 3), count(user_id))",
    "ret_impressions_per_user": "try_divide(sum(views), count(user_id))", "ret_completion_rate": "try_divide(sum(purchases), sum(clicks))",
}
OPERATIONAL_METRICS = {
    "dau": "count(user_id)", "revenue": "sum(revenue)", "payers": "count_if(purchases > 0)", "payer_rate": "try_divide(count_if(purchases > 0), count(user_id))", "arpdau": "try_divide(sum(revenue), count(user_id))",
    "arppu": "try_divide(sum(revenue), count_if(purchases > 0))", "purchases_per_payer": "try_divide(sum(purchases), count_if(purchases > 0))", "avg_ticket": "try_divide(sum(revenue), sum(purchases))",
    "error_rate": "try_divide(sum(errors), sum(events))", "error_users_share": "try_divide(count_if(errors > 0), count(user_id))", "attempt_success": "try_divide(sum(purchases), sum(purchases) + sum(errors))",
    "views_per_user": "try_divide(sum(views), count(user_id))", "click_through": "try_divide(sum(clicks), sum(views))", "suspicious_share": "try_divide(count_if(suspicious), count(user_id))",
    "suspicious_revenue_share": "try_divide(sum(if(suspicious, revenue, 0)), sum(revenue))", "multi_purchase_share": "try_divide(count_if(purchases >= 2), count_if(purchases > 0))",
}


def catalogue():
    out = [Alert(n, m, where="is_new") for n, m in NEW_USER_METRICS.items()]
    out += [Alert(n, m, where="came_back") for n, m in RETURNING_METRICS.items()]
    out += [Alert(n, m, dims=("platform",)) for n, m in OPERATIONAL_METRICS.items()]
    return out


def _duck(m):
    import re
    m = m.replace("if(suspicious, revenue, 0)", "CASE WHEN suspicious THEN revenue ELSE 0 END")
    m = re.sub(r"count_if\(([^()]*)\)", r"count(CASE WHEN \1 THEN 1 END)", m)
    if m.startswith("try_divide("):
        body, depth = m[len("try_divide("):-1], 0
        for i, ch in enumerate(body):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                return f"CAST({body[:i]} AS DOUBLE)/nullif({body[i + 1:]}, 0)"
    return m


def _values_sql(metrics, where="true", dim="NULL::VARCHAR"):
    return " UNION ALL ".join(f"SELECT '{n}' AS alert, day AS validation_date, {dim} AS dim1, NULL::VARCHAR AS dim2, CAST({_duck(m)} AS DOUBLE) AS value FROM x WHERE {where} GROUP BY day" + (f", {dim}" if dim == "platform" else "") for n, m in metrics.items())


@query("z1_alert_eval", f"WITH {_UDT}, v AS ({_values_sql(OPERATIONAL_METRICS, dim='platform')}) SELECT alert, CAST(validation_date AS VARCHAR) AS validation_date, dim1, dim2, round(value, 6) AS value FROM v")
def z1(t):
    return A.metric_values(user_day_table(t), [a for a in catalogue() if a.dims])


@query("z1_catalogue_new_users", f"WITH {_UDT}, v AS ({_values_sql(NEW_USER_METRICS, 'is_new')}) SELECT alert, CAST(validation_date AS VARCHAR) AS validation_date, dim1, dim2, round(value, 6) AS value FROM v")
def z1b(t):
    return A.metric_values(user_day_table(t), [a for a in catalogue() if a.where == "is_new"])


@query("z1_catalogue_returning", f"WITH {_UDT}, v AS ({_values_sql(RETURNING_METRICS, 'came_back')}) SELECT alert, CAST(validation_date AS VARCHAR) AS validation_date, dim1, dim2, round(value, 6) AS value FROM v")
def z1c(t):
    return A.metric_values(user_day_table(t), [a for a in catalogue() if a.where == "came_back"])


ABS = [Alert("dau", "count(user_id)", ("platform",), lower=42.0), Alert("error_rate", "try_divide(sum(errors), sum(events))", ("platform",), upper=0.22)]
_VABS = _values_sql({"dau": "count(user_id)", "error_rate": "try_divide(sum(errors), sum(events))"}, dim="platform")
_SABS = f"WITH {_UDT}, v AS ({_VABS}), s AS (SELECT *, CASE WHEN (alert = 'dau' AND value < 42) OR (alert = 'error_rate' AND value > 0.22) THEN 'FAIL' ELSE 'PASS' END AS status FROM v)"


@query("z2_absolute_threshold", _SABS + " SELECT alert, CAST(validation_date AS VARCHAR) AS validation_date, dim1, round(value, 6) AS value, status FROM s")
def z2(t):
    v = A.metric_values(user_day_table(t), ABS)
    return A.absolute_status(v, A.definitions(t.spark, ABS)).select("alert", "validation_date", "dim1", "value", "status")


REL = [Alert("revenue", "sum(revenue)", ("platform",), relative="15", data_points=5), Alert("dau", "count(user_id)", ("platform",), relative="3-", data_points=3, seasonality=7)]
_VREL = _values_sql({"revenue": "sum(revenue)", "dau": "count(user_id)"}, dim="platform")


@query("z3_relative_threshold", f"""WITH {_UDT}, v AS ({_VREL}), d AS (SELECT * FROM (VALUES ('revenue', 15.0, 'both', 5, 1), ('dau', 3.0, '-', 3, 7)) q(alert, pct, side, n, step)),
j AS (SELECT v.*, d.pct, d.side, d.n, (SELECT avg(o.value) FROM v o WHERE o.alert = v.alert AND o.dim1 = v.dim1 AND o.validation_date < v.validation_date AND (v.validation_date - o.validation_date) % d.step = 0 AND (v.validation_date - o.validation_date) / d.step <= d.n) AS baseline,
 (SELECT count(o.value) FROM v o WHERE o.alert = v.alert AND o.dim1 = v.dim1 AND o.validation_date < v.validation_date AND (v.validation_date - o.validation_date) % d.step = 0 AND (v.validation_date - o.validation_date) / d.step <= d.n) AS n_points FROM v JOIN d USING (alert)),
k AS (SELECT *, 100*(value - baseline)/nullif(abs(baseline), 0) AS dev FROM j)
SELECT alert, CAST(validation_date AS VARCHAR) AS validation_date, dim1, round(value, 4) AS value, round(baseline, 4) AS baseline, n_points, round(dev, 4) AS deviation_pct,
 CASE WHEN n_points < n THEN 'INSUFFICIENT' WHEN (side <> '-' AND dev > pct) OR (side <> '+' AND dev < -pct) THEN 'FAIL' ELSE 'PASS' END AS status FROM k""", digits=4)
def z3(t):
    v = A.metric_values(user_day_table(t), REL)
    return A.relative_status(v, A.definitions(t.spark, REL)).drop("dim2")


@query("z4_flow_validation", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS step, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2),
p AS (SELECT *, lag(n) OVER (PARTITION BY day ORDER BY step) AS previous FROM s)
SELECT CAST(day AS VARCHAR) AS day, step, n, round(100*abs(n - previous)/previous, 4) AS diff_pct, CASE WHEN coalesce(100*abs(n - previous)/previous > 25, false) THEN 'FAIL' ELSE 'PASS' END AS status FROM p""", digits=4)
def z4(t):
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3)
    s = t.events.withColumn("step", step).where("step IS NOT NULL").groupBy(F.to_date("ts").alias("day"), "step").agg(N().alias("n"))
    return A.flow_status(s, "day", "step", "n", 25.0).drop("previous")


@query("z5_recovery_filter", _SABS + """, p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY alert, dim1 ORDER BY validation_date), 'PASS') AS prev FROM s)
SELECT alert, CAST(validation_date AS VARCHAR) AS validation_date, dim1, CASE WHEN status = 'FAIL' THEN 'FIRED' ELSE 'RECOVERED' END AS notice FROM p WHERE status <> prev""")
def z5(t):
    v = A.metric_values(user_day_table(t), ABS)
    return A.recovery_filter(A.absolute_status(v, A.definitions(t.spark, ABS))).select("alert", "validation_date", "dim1", "notice")


@query("z6_intraday_aggregation", """
SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""", digits=2)
def z6(t):
    return A.intraday(t.events, "ts", 15, ["event_type"], {"n": N(), "total": F.sum("value")})


def hourly(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(N().alias("n"))


_HR = "h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1)"


@query("z7_seasonal_baseline", f"""WITH {_HR}, k AS (SELECT unnest(range(1, 8)) AS k), a AS (SELECT hour + INTERVAL 1 DAY * k AS hour, n AS b FROM h, k), g AS (SELECT hour, avg(b) AS baseline, count(*) AS n_points FROM a GROUP BY 1)
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n, round(baseline, 4) AS baseline, n_points, round(100*(n-baseline)/abs(baseline), 4) AS deviation_pct FROM h JOIN g USING (hour)""", digits=4)
def z7(t):
    return A.seasonal_baseline(hourly(t), "hour", "n", [])


@query("z7_weekday_baseline", f"""WITH {DAILY_SQL}, k AS (SELECT unnest(range(1, 5)) AS k), a AS (SELECT day + CAST(7*k AS INT) AS day, events AS b FROM d, k), g AS (SELECT day, avg(b) AS baseline, count(*) AS n_points FROM a GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, events, round(baseline, 4) AS baseline, n_points, round(100*(events-baseline)/abs(baseline), 4) AS deviation_pct FROM d JOIN g USING (day)""", digits=4)
def z7b(t):
    return A.seasonal_baseline(daily(t).select("day", "events"), "day", "events", [], "day")


@query("z8_volume_cliff", f"""WITH {_HR}, p AS (SELECT *, lag(n) OVER (PARTITION BY CAST(hour AS DATE) ORDER BY hour) AS previous FROM h)
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n, previous, round(1 - n/previous, 6) AS "drop" FROM p WHERE hour(hour) BETWEEN 13 AND 19 AND 1 - n/previous > 0.4""")
def z8(t):
    return A.volume_cliff(hourly(t), "hour", "n", drop=0.4)


_PRATE = "r AS (SELECT CAST(ts AS DATE) AS day, 'p' || CAST(user_id % 3 AS VARCHAR) AS platform, CAST(count(CASE WHEN event_type='purchase' THEN 1 END) AS DOUBLE)/nullif(count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END), 0) AS rate FROM events GROUP BY 1, 2)"


def platform_rates(t):
    return t.events.groupBy(F.to_date("ts").alias("day"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("platform")).agg(
        ratio(F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "error"))).alias("rate"))


@query("z9_group_gap", f"WITH {_PRATE} SELECT CAST(day AS VARCHAR) AS day, round(max(rate), 6) AS best, round(min(rate), 6) AS worst, min_by(platform, rate) AS worst_group, round(max(rate) - min(rate), 6) AS gap, CASE WHEN max(rate) - min(rate) > 0.15 THEN 'FAIL' ELSE 'PASS' END AS status FROM r GROUP BY 1")
def z9(t):
    return A.group_gap(platform_rates(t), "day", "platform", "rate")


@query("z9_lone_drop", f"""WITH {_PRATE}, c AS (SELECT *, 100*(rate - lag(rate) OVER (PARTITION BY platform ORDER BY day))/nullif(abs(lag(rate) OVER (PARTITION BY platform ORDER BY day)), 0) AS c FROM r),
g AS (SELECT day, count(CASE WHEN c < -10 THEN 1 END) AS nd, count(CASE WHEN c >= -5 THEN 1 END) AS nh, count(*) AS n, min_by(platform, c) AS "group" FROM c WHERE c IS NOT NULL GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, "group" FROM g WHERE nd = 1 AND nh = n - 1""")
def z9b(t):
    return A.lone_drop(platform_rates(t), "day", "platform", "rate", 10.0, 5.0)


@query("z10_share_shift", """
WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, n/sum(n) OVER (PARTITION BY month) AS share FROM g),
p AS (SELECT *, share - lag(share) OVER (PARTITION BY o_orderstatus ORDER BY month) AS shift FROM s)
SELECT CAST(month AS VARCHAR) AS month, o_orderstatus, n, round(share, 6) AS share, round(shift, 6) + 0.0 AS shift, CASE WHEN share > 0.5 THEN 'SHARE' WHEN abs(shift) > 0.05 THEN 'SHIFT' END AS flag FROM p""")
def z10(t):
    g = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderstatus").agg(N().alias("n"))
    return A.share_shift(g, "month", "o_orderstatus", "n", 0.5, 0.05)


@query("z11_zero_success", "SELECT o_custkey, count(*) AS attempts, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS successes FROM orders GROUP BY 1 HAVING count(*) > 5 AND count(CASE WHEN o_orderstatus = 'F' THEN 1 END) = 0")
def z11(t):
    return A.zero_success(t.orders, ["o_custkey"], F.col("o_orderstatus") == "F", 5)


@query("z11_growth_over", """
WITH g AS (SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(n) OVER (PARTITION BY o_orderpriority ORDER BY week) AS previous FROM g)
SELECT o_orderpriority, CAST(week AS VARCHAR) AS week, n, previous FROM p WHERE n > 2*previous""")
def z11b(t):
    g = t.orders.groupBy("o_orderpriority", F.date_trunc("week", "o_orderdate").cast("date").alias("week")).agg(N().alias("n"))
    return A.growth_over(g, ["o_orderpriority"], "week", "n")


@query("z12_new_value", """
SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1999-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1999-01-01') GROUP BY 1""")
def z12(t):
    o = t.orders
    return A.new_values(o.where("o_orderdate >= '1999-01-01'"), o.where("o_orderdate < '1999-01-01'"), "o_custkey")


@query("z13_fixed_band", f"""WITH {DAILY_SQL}, v AS (SELECT day, revenue/users AS v FROM d), s AS (SELECT *, 100*(v - lag(v) OVER (ORDER BY day))/abs(lag(v) OVER (ORDER BY day)) AS sp, v - avg(v) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS dr FROM v)
SELECT CAST(day AS VARCHAR) AS day, round(v, 4) AS v, round(sp, 4) AS step_pct, round(dr, 4) AS drift, v < 13 OR v > 16 AS out_of_band, coalesce(abs(sp) > 10, false) AS big_step, coalesce(abs(dr) > 1.5, false) AS drifting FROM s""", digits=4)
def z13(t):
    s = daily(t).select("day", (F.col("revenue") / F.col("users")).alias("v"))
    return A.fixed_band(s, "day", "v", 13.0, 16.0, 10.0, 7, 1.5)


@query("z14_event_day_lift", f"""WITH {DAILY_SQL}, c AS (SELECT * FROM (VALUES ('launch', DATE '2024-01-03'), ('sale', DATE '2024-01-05'), ('season', DATE '2024-01-20')) v(event, s)),
g AS (SELECT event, s, max(CASE WHEN day = s THEN events END) AS ev, avg(CASE WHEN day < s THEN events END) AS pm, count(CASE WHEN day < s THEN 1 END) AS n FROM d JOIN c ON day BETWEEN s - 14 AND s GROUP BY 1, 2)
SELECT event, CAST(s AS VARCHAR) AS start, ev AS event_value, round(pm, 6) AS prior_mean, n AS n_prior, round(ev/pm, 6) AS lift, CASE WHEN ev/pm >= 1.0 THEN 'PASS' WHEN ev/pm IS NULL THEN 'INSUFFICIENT' ELSE 'FAIL' END AS status FROM g""")
def z14(t):
    return A.event_day_lift(daily(t), "day", "events", event_calendar(t), min_lift=1.0)
