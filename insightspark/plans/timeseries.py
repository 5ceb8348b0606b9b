"""Time series and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.operators import forecast as FC
from insightspark.operators import series as X
from insightspark.plans.registry import query
from insightspark.plans.relational import event_calendar
from insightspark.plans.windows import DAILY_SQL, daily

N = lambda: F.count(F.lit(1))


def type_days(t):
    """Events per type and day."""
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(N().alias("n"), F.round(F.sum("value"), 2).alias("total"))


_TD = "td AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)"
_IX = "ix AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS idx, count(*) OVER (PARTITION BY event_type) AS np FROM td)"


def prio_months(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("prio"), F.trunc("o_orderdate", "month").alias("month")).agg(N().alias("n"))


_PM = "pm AS (SELECT o_orderpriority AS prio, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2), px AS (SELECT *, row_number() OVER (PARTITION BY prio ORDER BY month) AS idx, count(*) OVER (PARTITION BY prio) AS np FROM pm)"


@query("x1_prepare_series", f"""WITH {_TD}, h AS (SELECT event_type, day, CASE WHEN day(day) % 4 = 1 THEN NULL ELSE n END AS v FROM td),
f AS (SELECT event_type, day, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM h)
SELECT event_type, CAST(day AS VARCHAR) AS day, CAST(v AS DOUBLE) AS v FROM f WHERE v IS NOT NULL""")
def x1(t):
    s = type_days(t).select("event_type", "day", F.when(F.day("day") % 4 != 1, F.col("n")).alias("v"))
    return X.prepare_series(s, ["event_type"], "day", "v")


@query("x2_naive_forecasts", f"""WITH {_TD}, {_IX}, e AS (SELECT event_type, max(day) AS ld, max(np) AS n, max_by(n, idx) AS last, min_by(n, idx) AS first, avg(CASE WHEN idx > np - 7 THEN n END) AS mean FROM ix GROUP BY 1),
s AS (SELECT *, unnest(range(1, 11)) AS step FROM e)
SELECT 'last' AS method, event_type, step, CAST(ld + CAST(step AS INT) AS VARCHAR) AS day, CAST(last AS DOUBLE) AS forecast FROM s
UNION ALL SELECT 'mean', event_type, step, CAST(ld + CAST(step AS INT) AS VARCHAR), round(mean, 6) FROM s UNION ALL SELECT 'drift', event_type, step, CAST(ld + CAST(step AS INT) AS VARCHAR), round(last + (last - first)/(n - 1)*step, 6) FROM s
UNION ALL SELECT 'seasonal_naive', s.event_type, step, CAST(ld + CAST(step AS INT) AS VARCHAR), CAST(ix.n AS DOUBLE) FROM s JOIN ix ON ix.event_type = s.event_type AND ix.idx = s.n - 7 + (step - 1) % 7 + 1""")
def x2(t):
    td = type_days(t)
    return X.union_all([X.naive_forecast(td, ["event_type"], "day", "n", 10, m, cycle=7).withColumn("method", F.lit(m)).withColumn("step", F.col("step").cast("long"))
                        for m in ("last", "mean", "drift", "seasonal_naive")])


_ACF = f"""{_TD}, {_IX}, d AS (SELECT event_type, idx, np, n - avg(n) OVER (PARTITION BY event_type) AS dv, var_pop(n) OVER (PARTITION BY event_type) AS vp FROM ix),
l AS (SELECT *, unnest(range(1, CAST(floor(np/2) AS BIGINT) + 1)) AS lag FROM d), a AS (SELECT l.event_type, lag, max(l.np) AS np, avg(l.dv*r.dv)/max(l.vp) AS acf FROM l JOIN d r ON r.event_type = l.event_type AND r.idx = l.idx + lag GROUP BY 1, 2),
p AS (SELECT *, lag(acf) OVER w AS pl, lead(acf) OVER w AS pr FROM a WINDOW w AS (PARTITION BY event_type ORDER BY lag)), k AS (SELECT * FROM p WHERE acf > pl AND acf > pr AND acf > 2/sqrt(np))"""


@query("x3_acf", f"WITH {_ACF} SELECT event_type, lag, round(acf, 6) AS acf FROM a")
def x3(t):
    return X.acf(type_days(t), ["event_type"], "day", "n").select("event_type", F.col("lag").cast("long").alias("lag"), "acf")


@query("x3_seasonality", f"""WITH {_ACF}, r AS (SELECT event_type, max_by(lag, acf) AS dominant_period, max(acf) AS s, count(*) AS n_peaks FROM k GROUP BY 1)
SELECT event_type, dominant_period, round(s, 6) AS strength, n_peaks, CASE WHEN s > 0.5 THEN 'strong' WHEN s > 0.3 THEN 'moderate' ELSE 'weak' END AS label FROM r""")
def x3b(t):
    return X.dominant_period(type_days(t), ["event_type"], "day", "n").withColumn("dominant_period", F.col("dominant_period").cast("long"))


@query("x4_exponential_smoothing")
def x4(t):
    td = type_days(t)
    runs = [("simple", dict(alpha=0.3)), ("holt", dict(alpha=0.3, beta=0.1)), ("holt_winters", dict(alpha=0.3, beta=0.1, period=7))]
    return X.union_all([FC.exponential_smoothing(td, ["event_type"], "day", "n", **kw).withColumn("model", F.lit(m)) for m, kw in runs])


@query("x4_simple_smoothing_sql", f"""WITH RECURSIVE {_TD}, {_IX}, r AS (SELECT event_type, idx, CAST(n AS DOUBLE) AS level FROM ix WHERE idx = 1 UNION ALL SELECT ix.event_type, ix.idx, 0.25*ix.n + 0.75*r.level FROM r JOIN ix ON ix.event_type = r.event_type AND ix.idx = r.idx + 1)
SELECT event_type, CAST(day AS VARCHAR) AS day, round(level, 6) AS fitted FROM r JOIN ix USING (event_type, idx)""")
def x4b(t):
    return FC.exponential_smoothing(type_days(t), ["event_type"], "day", "n", alpha=0.25, mode="reference").select("event_type", "day", "fitted")


@query("x5_alpha_search")
def x5(t):
    return FC.fit_quality(FC.exponential_smoothing(type_days(t), ["event_type"], "day", "n"), ["event_type"])


def _runs(s):
    return f"""w3 AS (SELECT *, count(z) OVER a AS c3, count(CASE WHEN z > 1 THEN 1 END) OVER a AS u3, count(CASE WHEN z < -1 THEN 1 END) OVER a AS d3, count(z) OVER b AS c5, count(CASE WHEN z > 1 THEN 1 END) OVER b AS u5,
 count(CASE WHEN z < -1 THEN 1 END) OVER b AS d5, count(CASE WHEN z > 2 THEN 1 END) OVER a AS uu3, count(CASE WHEN z < -2 THEN 1 END) OVER a AS dd3, count(z) OVER c AS c8, count(CASE WHEN n > center THEN 1 END) OVER c AS u8, count(CASE WHEN n < center THEN 1 END) OVER c AS d8 FROM {s}
 WINDOW a AS (PARTITION BY prio ORDER BY month ROWS 2 PRECEDING), b AS (PARTITION BY prio ORDER BY month ROWS 4 PRECEDING), c AS (PARTITION BY prio ORDER BY month ROWS 7 PRECEDING))
SELECT prio, CAST(month AS VARCHAR) AS month, CAST(n AS DOUBLE) AS value, round(center, 6) AS center, round(z, 6) AS z, rule FROM (
 SELECT *, 'beyond_limit' AS rule FROM w3 WHERE abs(z) > 2 UNION ALL SELECT *, '2_of_3_beyond_2' FROM w3 WHERE c3 = 3 AND (uu3 >= 2 OR dd3 >= 2)
 UNION ALL SELECT *, '4_of_5_beyond_1' FROM w3 WHERE c5 = 5 AND (u5 >= 4 OR d5 >= 4) UNION ALL SELECT *, '8_one_side' FROM w3 WHERE c8 = 8 AND (u8 = 8 OR d8 = 8))"""


@query("x6_control_chart", f"WITH {_PM}, m AS (SELECT *, avg(n) OVER (PARTITION BY prio) AS center, stddev_samp(n) OVER (PARTITION BY prio) AS sd FROM px), z AS (SELECT *, (n - center)/sd AS z FROM m), " + _runs("z"))
def x6(t):
    return X.control_chart(prio_months(t), ["prio"], "month", "n", sigma=2.0)


@query("x6_control_chart_rolling", f"""WITH {_PM}, m AS (SELECT *, CASE WHEN count(n) OVER w >= 2 THEN avg(n) OVER w END AS center, CASE WHEN count(n) OVER w >= 2 THEN stddev_samp(n) OVER w END AS sd FROM px WINDOW w AS (PARTITION BY prio ORDER BY month ROWS 11 PRECEDING)),
z AS (SELECT *, CASE WHEN center IS NULL THEN NULL WHEN coalesce(sd, 0) > 0 THEN (n - center)/sd ELSE 0 END AS z FROM m), """ + _runs("z"))
def x6b(t):
    return X.control_chart(prio_months(t), ["prio"], "month", "n", sigma=2.0, window=12)


@query("x7_granularity", """
SELECT event_type, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS span_days,
 CASE WHEN max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 < 90 THEN 'daily' ELSE 'weekly' END AS granularity FROM events GROUP BY 1""")
def x7(t):
    return X.granularity(t.events, "ts", ["event_type"]).withColumn("span_days", F.col("span_days").cast("long"))


@query("x8_rate_of_change_anomaly", f"""WITH {_PM}, c AS (SELECT *, n - lag(n) OVER (PARTITION BY prio ORDER BY month) AS ch FROM px), m AS (SELECT *, avg(abs(ch)) OVER (PARTITION BY prio) AS ms FROM c)
SELECT prio, CAST(month AS VARCHAR) AS month, n, ch AS change, round(ms, 6) AS mean_step FROM m WHERE abs(ch) > 2*ms""")
def x8(t):
    return X.rate_of_change_anomalies(prio_months(t), ["prio"], "month", "n")


@query("x9_structural_break", f"""WITH {_PM}, h AS (SELECT *, idx <= floor(np/2) AS a FROM px), g AS (SELECT prio, avg(CASE WHEN a THEN n END) AS m1, avg(CASE WHEN NOT a THEN n END) AS m2, var_samp(CASE WHEN a THEN n END) AS v1, var_samp(CASE WHEN NOT a THEN n END) AS v2,
 regr_slope(CASE WHEN a THEN n END, idx) AS s1, regr_slope(CASE WHEN NOT a THEN n END, idx) AS s2 FROM h GROUP BY 1)
SELECT prio, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, round(v1, 6) AS var_1, round(v2, 6) AS var_2, round(s1, 6) AS slope_1, round(s2, 6) AS slope_2, round(100*(m2-m1)/abs(m1), 6) AS mean_shift_pct, round(v2/v1, 6) AS var_ratio FROM g""")
def x9(t):
    return X.structural_break(prio_months(t), ["prio"], "month", "n")


_FIT = "f AS (SELECT prio, regr_slope(n, idx) AS slope, regr_intercept(n, idx) AS intercept, regr_r2(n, idx) AS r2, count(*) AS n, avg(n) AS mean FROM px GROUP BY 1)"


@query("x10_trend_line", f"WITH {_PM}, f AS (SELECT prio, regr_slope(n, idx) AS slope, regr_intercept(n, idx) AS intercept, regr_r2(n, idx) AS r2, count(*) AS k, avg(n) AS mean FROM px WHERE month <> DATE '2001-08-01' GROUP BY 1) "
       "SELECT prio, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, k AS n, round(mean, 6) AS mean, round(100*slope/abs(mean), 6) AS pct_per_period FROM f")
def x10(t):
    return X.trend_line(prio_months(t), ["prio"], "month", "n", exclude=F.col("month") == F.lit("2001-08-01").cast("date"))


@query("x11_decompose", f"""WITH {_PM}, {_FIT}, d AS (SELECT px.prio, month, px.n, intercept + slope*idx AS trend, (idx-1) % 12 AS phase FROM px JOIN f USING (prio)), s AS (SELECT *, avg(n - trend) OVER (PARTITION BY prio, phase) AS seasonal FROM d)
SELECT prio, CAST(month AS VARCHAR) AS month, n, round(trend, 6) AS trend, CAST(phase AS BIGINT) AS phase, round(seasonal, 6) AS seasonal, round(n - trend - seasonal, 6) + 0.0 AS residual FROM s""")
def x11(t):
    return X.decompose(prio_months(t), ["prio"], "month", "n", 12).withColumn("phase", F.col("phase").cast("long"))


@query("x12_segment_divergence", f"""WITH {_PM}, {_FIT}, t AS (SELECT prio, sum(n) AS s FROM pm GROUP BY 1)
SELECT prio, round(slope, 6) AS slope, round(100*slope/abs(mean), 6) AS pct_per_period, round(s/(SELECT sum(n) FROM pm), 6) AS share, CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS direction FROM f JOIN t USING (prio)""")
def x12(t):
    return X.segment_divergence(prio_months(t), "prio", "month", "n")


@query("x13_partial_period_drop", """
SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('week', min(ts)) >= DATE '2024-01-01' AND CAST(date_trunc('week', min(ts)) AS DATE) + 6 <= DATE '2024-01-30'""")
def x13(t):
    w = t.events.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(N().alias("n"))
    return X.drop_partial_periods(w, "week", "week", "2024-01-01", "2024-01-30")


@query("x14_indexed_series", f"WITH {_PM}, b AS (SELECT *, avg(CASE WHEN idx <= 6 THEN n END) OVER (PARTITION BY prio) AS base FROM px) SELECT prio, CAST(month AS VARCHAR) AS month, n, round(100*n/base, 6) AS indexed FROM b")
def x14(t):
    return X.index_to_base(prio_months(t), ["prio"], "month", "n", 6)


@query("x15_event_overlay", f"""WITH {DAILY_SQL}, c AS (SELECT day, events - lag(events) OVER (ORDER BY day) AS change FROM d), a AS (SELECT * FROM c WHERE abs(change) > 1.5*(SELECT avg(abs(change)) FROM c)),
k AS (SELECT * FROM (VALUES ('launch', DATE '2024-01-03', DATE '2024-01-06'), ('sale', DATE '2024-01-05', DATE '2024-01-12'), ('season', DATE '2024-01-20', DATE '2024-01-29')) v(event, s, e))
SELECT CAST(day AS VARCHAR) AS day, CAST(change AS DOUBLE) AS change, event FROM a LEFT JOIN k ON day BETWEEN s AND e""")
def x15(t):
    a = X.rate_of_change_anomalies(daily(t).select("day", "events"), [], "day", "events", 1.5)
    return X.event_overlay(a, "day", event_calendar(t)).select("day", F.col("change").cast("double").alias("change"), "event")
