"""Root cause and opportunity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.operators import rootcause as R
from insightspark.plans.paradox import _OC, oc
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))
_DIMS = ["o_orderpriority", "o_orderstatus", "c_mktsegment", "n_regionkey"]


def scoped(t):
    """1998 as the anomaly against 1997, with extra weight on one segment."""
    df = oc(t).where("o_orderdate >= '1997-01-01' AND o_orderdate < '1999-01-01'")
    boost = F.when((F.col("o_orderdate") >= "1998-01-01") & (F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderpriority") == "1-URGENT"), 3.0).otherwise(1.0)
    return df.withColumn("span", F.when(F.col("o_orderdate") < "1998-01-01", "base").otherwise("anomaly")).withColumn("amount", F.col("o_totalprice") * boost)


_SC = f"""{_OC}, sc AS (SELECT *, CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'base' ELSE 'anomaly' END AS span,
 o_totalprice * CASE WHEN o_orderdate >= DATE '1998-01-01' AND c_mktsegment = 'MACHINERY' AND o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END AS amount FROM oc WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01')"""


def _contrib(dims):
    longs = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {c} AS val, span, amount FROM sc" for n, c in dims)
    return f"""WITH {_SC}, l AS ({longs}), g AS (SELECT dimension, val, coalesce(sum(CASE WHEN span='base' THEN amount END), 0) AS base, coalesce(sum(CASE WHEN span='anomaly' THEN amount END), 0) AS anomaly FROM l GROUP BY 1, 2),
c AS (SELECT *, anomaly - base AS change, (anomaly - base)/sum(anomaly - base) OVER (PARTITION BY dimension) AS contribution FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY contribution DESC, val) AS rank FROM c)"""


_D4 = [(d, f"CAST({d} AS VARCHAR)") for d in _DIMS]
_OUT = " SELECT dimension, val, round(base, 2) AS base, round(anomaly, 2) AS anomaly, round(change, 2) AS change, round(contribution, 4) AS contribution, rank FROM r"


def _shape(df):
    return df.select("dimension", "val", F.round("base", 2).alias("base"), F.round("anomaly", 2).alias("anomaly"), F.round("change", 2).alias("change"), "contribution", F.col("rank").cast("long").alias("rank"))


@query("y23_root_cause_step", _contrib(_D4) + _OUT, digits=4)
def y23(t):
    return _shape(R.contributions(scoped(t), _DIMS, "span", "amount"))


@query("y23_explanatory_power", _contrib(_D4) + """, p AS (SELECT dimension, max(CASE WHEN rank=1 THEN contribution END) AS top1, sum(CASE WHEN rank<=2 THEN contribution END) AS top2, max(CASE WHEN rank=1 THEN val END) AS top_value FROM r GROUP BY 1)
SELECT dimension, round(top1, 4) AS top1, round(top2, 4) AS top2, top_value, CASE WHEN top1 > 0.5 THEN 'HIGH' WHEN top2 > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS power FROM p""", digits=4)
def y23b(t):
    return R.explanatory_power(R.contributions(scoped(t), _DIMS, "span", "amount"))


def _levels(most=4):
    """The search unrolled: each level takes the strongest dimension left among the rows of the values taken so far."""
    value = lambda j: "CASE (SELECT dimension FROM b%d) %s END = (SELECT top_value FROM b%d)" % (j, " ".join(f"WHEN '{d}' THEN coalesce({c}, '(none)')" for d, c in _D4), j)
    parts = []
    for k in range(1, most + 1):
        where = " AND ".join(["true", *[value(j) for j in range(1, k)]])
        left = " AND ".join(["true", *[f"dimension <> (SELECT dimension FROM b{j})" for j in range(1, k)]])
        going = "true" if k <= 3 else f"(SELECT 1 - explained >= 0.1 FROM b{k - 1})"
        longs = " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({c}, '(none)') AS val, span, amount FROM sc WHERE {where}" for d, c in _D4)
        before = "1.0" if k == 1 else f"(SELECT explained FROM b{k - 1})"
        parts.append(f"""b{k} AS (SELECT {k} AS level, dimension, top_value, top1, CASE WHEN top1 > 0.5 THEN 'HIGH' WHEN top2 > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS power, top1 * {before} AS explained FROM (
 SELECT dimension, max(CASE WHEN rank = 1 THEN val END) AS top_value, max(CASE WHEN rank = 1 THEN contribution END) AS top1, sum(CASE WHEN rank <= 2 THEN contribution END) AS top2 FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY contribution DESC, val) AS rank FROM (
   SELECT dimension, val, (anomaly - base) / sum(anomaly - base) OVER (PARTITION BY dimension) AS contribution FROM (
    SELECT dimension, val, coalesce(sum(CASE WHEN span = 'base' THEN amount END), 0) AS base, coalesce(sum(CASE WHEN span = 'anomaly' THEN amount END), 0) AS anomaly FROM ({longs}) WHERE {left} GROUP BY 1, 2))) GROUP BY 1)
 WHERE {going} AND top1 IS NOT NULL ORDER BY top1 DESC, dimension LIMIT 1)""")
    return f"WITH {_SC}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT CAST(level AS INT) AS level, dimension, top_value, round(top1, 4) AS contribution, power, round(explained, 4) AS explained FROM b{k}" for k in range(1, most + 1))


@query("y24_root_cause_loop", _levels(), digits=4)
def y24(t):
    return R.search(scoped(t), _DIMS, "span", "amount")


@query("y24_interaction", _contrib([("c_mktsegment × o_orderpriority", "c_mktsegment || ' × ' || o_orderpriority")]) + _OUT, digits=4)
def y24b(t):
    return _shape(R.interaction(scoped(t), "c_mktsegment", "o_orderpriority", "span", "amount"))


@query("y25_baseline_excess", """
WITH m AS (SELECT o_orderpriority AS prio, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT *, avg(n) OVER (PARTITION BY prio ORDER BY month ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS ex, row_number() OVER (PARTITION BY prio ORDER BY month) AS i FROM m),
a AS (SELECT *, i - row_number() OVER (PARTITION BY prio ORDER BY month) AS g FROM e WHERE abs(100*(n-ex)/abs(ex)) > 15)
SELECT prio, CAST(min(month) AS VARCHAR) AS anomaly_start, CAST(max(month) AS VARCHAR) AS anomaly_end, count(*) AS periods, round(sum(n-ex), 4) AS excess, round(sum(ex), 4) AS expected, round(100*sum(n-ex)/abs(sum(ex)), 4) AS excess_pct FROM a GROUP BY prio, g""", digits=4)
def y25(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("prio"), F.trunc("o_orderdate", "month").alias("month")).agg(N().cast("double").alias("n"))
    return R.baseline_excess(m, ["prio"], "month", "n", limit_pct=15.0)


@query("y26_isolate_check", f"WITH {_SC} SELECT span, round(sum(amount)/count(*), 4) AS metric, round(sum(CASE WHEN c_mktsegment <> 'MACHINERY' THEN amount END)/count(CASE WHEN c_mktsegment <> 'MACHINERY' THEN 1 END), 4) AS metric_without FROM sc GROUP BY 1", digits=4)
def y26(t):
    return R.isolate(scoped(t).withColumn("one", F.lit(1.0)), "c_mktsegment", "MACHINERY", "span", "amount", "one")


def segment_base(t):
    """Measured reach, rate and value per market segment."""
    per = oc(t).groupBy("c_mktsegment", "o_custkey").agg(F.sum("o_totalprice").alias("v"), F.max(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("f"))
    return per.groupBy("c_mktsegment").agg(N().alias("users"), F.avg("f").alias("rate"), F.avg("v").alias("value"))


_SB = f"{_OC}, pu AS (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS v, max(CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END) AS f FROM oc GROUP BY 1, 2), sb AS (SELECT c_mktsegment, count(*) AS users, avg(f) AS rate, avg(v) AS value FROM pu GROUP BY 1)"


@query("y27_opportunity_size", f"WITH {_SB} SELECT c_mktsegment, users, round(value, 2) AS value, round(users*0.02*value, 2) AS impact, round(users*0.02*value*12, 2) AS annual_impact FROM sb", digits=2)
def y27(t):
    return R.opportunity(segment_base(t), "users", 0.02, "value").drop("rate")


@query("y28_sensitivity_grid", f"""WITH {_SB}, g AS (SELECT *, CAST(1000000.0 AS DOUBLE) AS cost, unnest([-0.5, -0.25, 0.0, 0.25, 0.5]) AS a FROM sb), h AS (SELECT *, unnest([-0.5, -0.25, 0.0, 0.25, 0.5]) AS b FROM g)
SELECT c_mktsegment, CAST(a AS DOUBLE) AS reach_step, CAST(b AS DOUBLE) AS rate_step, round(users*(1+a)*rate*(1+b)*value, 2) AS outcome, round(cost/(users*(1+a)*value), 4) AS break_even_rate, users*(1+a)*rate*(1+b)*value > cost AS profitable FROM h""", digits=4)
def y28(t):
    g = R.sensitivity_grid(segment_base(t).withColumn("cost", F.lit(1e6)), "users", "rate", "value", "cost")
    return g.select("c_mktsegment", "reach_step", "rate_step", F.round("outcome", 2).alias("outcome"), "break_even_rate", "profitable")


@query("y29_scenarios_priority", f"""WITH {_SB} SELECT c_mktsegment, round(users*0.02*value*CASE WHEN users % 3 = 0 THEN 0.8 WHEN users % 3 = 1 THEN 0.5 ELSE 0.3 END, 2) AS expected_value,
 round(users*0.02*value*CASE WHEN users % 3 = 0 THEN 0.8 WHEN users % 3 = 1 THEN 0.5 ELSE 0.3 END/(1 + users % 5), 2) AS priority FROM sb""", digits=2)
def y29(t):
    b = R.opportunity(segment_base(t), "users", 0.02, "value")
    m = F.col("users") % 3
    b = b.withColumn("confidence", F.when(m == 0, "high").when(m == 1, "medium").otherwise("low")).withColumn("effort", 1 + F.col("users") % 5)
    return R.scenarios(b, "impact", "effort", "confidence").select("c_mktsegment", "expected_value", "priority")


@query("y30_waterfall_contribution", f"""WITH {_OC}, y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS u, count(*)/CAST(count(DISTINCT o_custkey) AS DOUBLE) AS f, avg(o_totalprice) AS a FROM oc GROUP BY 1),
b AS (SELECT u AS bu, f AS bf, a AS ba FROM y WHERE yr = 1995), i AS (SELECT yr, 100*u/bu AS cu, 100*f/bf AS cf, 100*a/ba AS ca FROM y, b), k AS (SELECT *, cu*cf*ca/10000 AS fin, ln(cu/100) + ln(cf/100) + ln(ca/100) AS t FROM i)
SELECT yr, round((fin-100)*ln(cu/100)/t, 4) AS contribution_users, round((fin-100)*ln(cf/100)/t, 4) AS contribution_frequency, round((fin-100)*ln(ca/100)/t, 4) AS contribution_value FROM k WHERE yr > 1995""", digits=4)
def y30(t):
    y = oc(t).groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.count_distinct("o_custkey").cast("double").alias("u"), N().alias("n"), F.avg("o_totalprice").alias("a"))
    y = y.withColumn("f", F.col("n") / F.col("u"))
    base = y.where("yr = 1995").select(F.struct("u", "f", "a")).scalar()
    i = y.withColumn("_b", base).select("yr", (100 * F.col("u") / F.col("_b.u")).alias("users"), (100 * F.col("f") / F.col("_b.f")).alias("frequency"), (100 * F.col("a") / F.col("_b.a")).alias("value"))
    i = i.withColumn("final", F.col("users") * F.col("frequency") * F.col("value") / 10000).where("yr > 1995")
    return R.waterfall(i, ["users", "frequency", "value"], "final").select("yr", "contribution_users", "contribution_frequency", "contribution_value")
